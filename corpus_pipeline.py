"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``; other columns are dropped.  Decisions are
of rows: with_rows() numbers those that a doc_id does not tell apart.  An empty
table passes every stage as an empty one.  run() applies them to ``documents``
and keeps each stage's table in the shared folder while the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enclosa.llm.common import Shared, table
from enclosa.llm.decontamination import leaks
from enclosa.llm.language_id import UND, fit, language_id
from enclosa.llm.packing import pack_documents
from enclosa.llm.queries import vocabulary
from enclosa.llm.rows import small, with_rows
from enclosa.llm.set_join import near_duplicates
from enclosa.llm.substring_dedup import removals

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shingles of five words and a Jaccard similarity of 0.8 in the near-duplicate stage.
WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``: null and empty texts too) go, and those whose two nearest codewords cannot be told apart.

    Rows are judged one by one, repeated ones and those without doc_id as well.
    """
    found = language_id(docs, fit(docs), extra=["lang", "source", "n_chars"])
    return found.where((F.col("lang_pred") != UND) & ~F.col("ambiguous")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of near duplicates stays, once.

    Rows without doc_id and further texts of a repeated one come after all
    others.  Of rows that repeat a doc_id and its text one stays.  Null and empty
    texts are near nothing and stay.
    """
    rows, _ = with_rows(spark, docs.select(*COLUMNS))
    shared = Shared(spark, "near-duplicates")
    near = near_duplicates(rows, key="row", n=WORDS, percent=PERCENT).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    near = shared.keep(near.select(F.col("doc_id").alias("row"), "n"), "stays")
    left = rows.join(small(near), "row")
    if near.where("n > 1").isEmpty():
        return left.select(*COLUMNS)
    again = left.where("n > 1").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("one")).select("one.*")
    return left.where("n = 1").select(*COLUMNS).unionByName(again)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier in the corpus are cut out; a document that has nothing else goes.

    Rows without doc_id come after all others.  A null text becomes an empty one and stays, as nothing is cut from it.
    """
    rows, _ = with_rows(spark, docs.select(*COLUMNS))
    cut = removals(rows.withColumnRenamed("doc_id", "own"), key="row", text_out=True, extra=["own", "lang", "source", "n_chars"], unique=True)
    left = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    cut = cut.where("n_removed = 0 OR trim(text) <> ''").withColumn("n_chars", left)
    return cut.select(F.col("own").alias("doc_id"), *COLUMNS[1:])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, whichever rows have them; null and empty texts contain none."""
    rows, _ = with_rows(spark, docs.select(*COLUMNS))
    found = leaks(rows, table(spark, sf_dir, "benchmark"), key="row").select(F.col("doc_id").alias("row")).distinct()
    found = Shared(spark, "leaks").keep(found, "found")
    return rows.join(small(found), "row", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each with its sequence and offset; null and empty texts are one separator, repeated rows are packed one by one."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_array", cut_repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Learning, approximate decoding and differencing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shared, kept = table(spark, sf_dir, "documents"), Shared(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, sf_dir), name)
        if kept is not None:
            shared.drop(kept)
        shared.release()
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
