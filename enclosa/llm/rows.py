"""Numbers for rows, where doc_id does not tell documents apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enclosa.llm.common import Shared

#: Numbers that are broadcast: 8 MB of them.
BROADCAST = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it if its rows, which are numbers, are few; otherwise it is joined by sorting."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def with_rows(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``row``, one number for each different (doc_id, text), and the (row, own) whose row is not their doc_id ``own``.

    The row is the doc_id; rows without one, and all but one of the different
    texts of a repeated one, are numbered after the greatest doc_id.  Texts are told
    apart by a 64-bit hash.  The second table is None where every row is its doc_id.
    A column ``row`` of ``docs`` is replaced.
    """
    shared = Shared(spark, "rows")
    h = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    ids = docs.select("doc_id", h.alias("h"))
    seen = ids.groupBy("doc_id").agg(F.min("h").alias("first"), F.max("h").alias("last"))
    seen = shared.keep(seen.where("doc_id IS NULL OR first < last"), "repeated")
    if seen.isEmpty():
        return docs.withColumn("row", F.col("doc_id")), None
    odd = ids.join(small(seen), ids["doc_id"].eqNullSafe(seen["doc_id"])).where(ids["doc_id"].isNull() | (F.col("h") > F.col("first"))).select(ids["doc_id"], "h").distinct().orderBy("h", "doc_id")
    top = docs.agg(F.max("doc_id")).first()[0]
    start = 0 if top is None else top + 1
    odd = shared.keep(spark.createDataFrame(odd.rdd.zipWithIndex().map(lambda x: (x[0][1], start + x[1], x[0][0])), "h long, row long, own long"), "numbers")
    known = odd.toDF("row_h", "row_number", "row_own")
    d = docs.withColumn("row_of", h).join(small(known), (F.col("row_of") == F.col("row_h")) & F.col("doc_id").eqNullSafe(F.col("row_own")), "left")
    return d.withColumn("row", F.coalesce("row_number", "doc_id")).drop("row_h", "row_number", "row_own", "row_of"), odd.select("row", "own")
