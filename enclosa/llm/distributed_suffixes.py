"""The difference-cover suffix sort as Spark jobs: no task ever holds more than its share of a text.

Karkkainen and Sanders' algorithm on a table of (pos, sym): triples at positions
1 and 2 modulo 3 are sorted by range partitioning and named by a distributed
count; if names repeat, the string of names is sorted in turn; the remaining
suffixes are sorted by first symbol and the rank behind it, and merged by two
sorted unions, in which running counts of either kind give the places.  What
comes to the driver are the row counts of partitions.

It moves each symbol through about ten exchanges at each level, of which there
are three times as many rows in all as symbols, so that it is for texts of which
little is left to sort: substring_dedup brings equal prefixes together by anchors
and sorts within tasks, and README gives the figures of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enclosa.llm.common import Shared, partitions
from enclosa.llm.difference_cover import suffix_array

#: Rows that one task sorts by itself at the end of the recursion, and positions that share a window for looking ahead.
LOCAL, CHUNK = 1 << 16, 1 << 12


def _ahead(d: DataFrame, columns: list[str], by: int = 2) -> DataFrame:
    """``d`` (pos and ``columns``) with each column's value at the next positions as name1, name2; null beyond the end."""
    here = d.withColumn("chunk", F.expr(f"pos div {CHUNK}")).withColumn("own", F.lit(True))
    seam = here.where((F.col("pos") % CHUNK < by) & (F.col("chunk") > 0)).withColumn("chunk", F.col("chunk") - 1).withColumn("own", F.lit(False))
    w = Window.partitionBy("chunk").orderBy("pos")
    more = [F.lead(c, k).over(w).alias(f"{c}{k}") for c in columns for k in range(1, by + 1)]
    return here.unionByName(seam).select(*d.columns, "own", *more).where("own").drop("own")


def _counted(d: DataFrame, keys: list[str], kind: Column, shared: Shared) -> DataFrame:
    """``d`` with at and kinds: the rows, and those of which ``kind`` holds, before each in the order of the keys."""
    spark = d.sparkSession
    # The order is written before it is numbered: a range partitioning drawn again could cut elsewhere.
    d = d.withColumn("kind_", kind.cast("long")).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("id_", F.monotonically_increasing_id())
    d = shared.keep(d, "ordered").withColumn("part_", F.shiftright("id_", 33))
    total = sorted(d.groupBy("part_").agg(F.count("*").alias("n"), F.sum("kind_").alias("k")).collect())
    rows, before = [], (0, 0)
    for r in total:
        rows.append((r["part_"], *before))
        before = before[0] + r["n"], before[1] + r["k"]
    start = spark.createDataFrame(rows, "part_ long, n0_ long, k0_ long")
    w = Window.partitionBy("part_").orderBy("id_").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.col("id_").bitwiseAND((1 << 33) - 1)).withColumn("kinds", F.coalesce(F.sum("kind_").over(w), F.lit(0).cast("long")))
    return d.join(F.broadcast(start), "part_").withColumn("at", F.col("at") + F.col("n0_")).withColumn("kinds", F.col("kinds") + F.col("k0_")).drop("part_", "id_", "kind_", "n0_", "k0_")


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        t = pa.Table.from_batches(held).sort_by("pos")
        sym = np.unique(t.column("sym").to_numpy(), return_inverse=True)[1] + 1
        order = suffix_array(sym)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        yield from pa.table({"pos": t.column("pos"), "rank": rank}).to_batches()


def suffix_ranks(d: DataFrame, shared: Shared, local: int = LOCAL) -> DataFrame:
    """(pos, rank), rank from 1 on, of the suffixes of a text of (pos, sym), pos 0, 1, ... and sym above 0."""
    n = d.count()
    if n <= max(local, 4):
        return shared.keep(d.select("pos", "sym").coalesce(1).mapInArrow(_local, "pos long, rank long"), "ranks")
    zero = F.lit(0).cast("long")
    symbols = shared.keep(_ahead(d.select("pos", "sym"), ["sym"]).select("pos", "sym", F.coalesce("sym1", zero).alias("sym1"), F.coalesce("sym2", zero).alias("sym2")), "symbols")
    sample = symbols.where("pos % 3 <> 0")
    if n % 3 == 1:  # the empty suffix closes the first class
        sample = sample.unionByName(d.sparkSession.createDataFrame([(n, 0, 0, 0)], "pos long, sym long, sym1 long, sym2 long"))
    triple = ["sym", "sym1", "sym2"]
    names = _counted(sample.select(*triple).distinct(), triple, F.lit(0), shared).select(*triple, (F.col("at") + 1).alias("name"))
    named = shared.keep(sample.join(names, triple).select("pos", "name"), "named")
    ones = (n + 1) // 3 + (n % 3 == 1)  # positions 1, 4, ...; n itself where it closes the class
    sampled = named.count()
    if named.select("name").distinct().count() == sampled:
        ranks = named.select("pos", F.col("name").alias("rank"))
    else:
        place = F.when(F.col("pos") % 3 == 1, F.expr("pos div 3")).otherwise(F.expr("pos div 3") + ones)
        inner = suffix_ranks(named.select(place.alias("pos"), F.col("name").alias("sym")), shared, local)
        back = F.when(F.col("pos") < ones, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - ones) + 2)
        ranks = inner.select(back.alias("pos"), "rank")
    every = symbols.join(ranks, "pos", "left").select("pos", "sym", "sym1", "rank")
    if n % 3 == 1:
        last = ranks.where(F.col("pos") == n).select("pos", zero.alias("sym"), zero.alias("sym1"), "rank")
        every = every.unionByName(last)
    every = shared.keep(_ahead(every, ["rank"]).select("pos", "sym", "sym1", "rank", F.coalesce("rank1", zero).alias("rank1"), F.coalesce("rank2", zero).alias("rank2")), "every").where(F.col("pos") < n)

    rest = F.col("pos") % 3 == 0
    first = _counted(every.where("pos % 3 <> 2"), ["sym", "rank1"], ~rest, shared)
    second = _counted(every.where("pos % 3 <> 1"), ["sym", "sym1", "rank2"], ~rest, shared)
    # Ranks of the sample count the empty suffix where there is one; it is the least.
    own = F.col("rank") - (2 if n % 3 == 1 else 1)
    one = first.where(~rest).select("pos", (own + F.col("at") - F.col("kinds")).alias("place"))
    two = second.where(~rest).select("pos", (own + F.col("at") - F.col("kinds")).alias("place"))
    three = first.where(rest).select("pos", "at").join(second.where(rest).select("pos", "kinds"), "pos").select("pos", (F.col("at") + F.col("kinds")).alias("place"))
    return shared.keep(one.unionByName(two).unionByName(three).select("pos", (F.col("place") + 1).alias("rank")), "ranks")
