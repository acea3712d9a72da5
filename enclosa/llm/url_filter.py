"""URL filters by a temporal list join.

A dated list has entries (host, action, day from which it holds).  Each entry
becomes a validity interval that ends where the next entry of its host begins;
an as-of join gives every capture the entry of its host, and of each parent
domain, that is active at fetch time.  The most specific domain with an active
entry decides.

The decision depends on host and fetch day alone, so captures are reduced to
these before the list is joined: a host with a third of all captures is a few
rows then, and so is a parent domain of many hosts, as domain and day are
made distinct once more.  The as-of join is a merge: the days asked for and the intervals
of a domain are sorted together, and each day takes the last interval that
began before it.  What one domain has there is bounded by the number of days,
however many hosts and entries it has.  Decisions come back to the captures by
equi-joins in which Spark splits skewed keys.

Null or hostless URLs have no host, match nothing and are kept.  Entries with a
null host, day or action are ignored; of several on one day the last action in
alphabetical order holds.  A capture without a fetch day matches nothing.
Repeated captures each get their row; an empty list keeps every capture, and
no captures give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """The lower-cased host: no user, port or trailing dot; null where there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels at least, the most specific first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame, host: str = "host", action: str = "action", day: str = "day") -> DataFrame:
    """host, action, valid_from, valid_to (exclusive; null while it holds)."""
    e = entries.select(F.lower(host).alias("host"), F.col(action).alias("action"), F.col(day).alias("valid_from")).dropna()
    e = e.groupBy("host", "valid_from").agg(F.max("action").alias("action"))
    return e.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("host").orderBy("valid_from")))


def as_of(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(domain, at, action, valid_from) for each distinct (domain, at) of ``points`` in an interval of the domain."""
    none = F.lit(None)
    asked = points.select("domain", "at").distinct().select("domain", "at", F.lit(1).alias("kind"), none.cast("string").alias("action"), none.cast("long").alias("valid_from"), none.cast("long").alias("valid_to"))
    known = spans.select(F.col("host").alias("domain"), F.col("valid_from").cast("long").alias("at"), F.lit(0).alias("kind"), "action", F.col("valid_from").cast("long"), F.col("valid_to").cast("long"))
    before = Window.partitionBy("domain").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.when(F.col("kind") == 0, F.struct("action", "valid_from", "valid_to"))
    met = known.unionByName(asked).withColumn("entry", F.last(entry, ignorenulls=True).over(before)).where("kind = 1 AND entry IS NOT NULL")
    return met.where("entry.valid_to IS NULL OR entry.valid_to > at").select("domain", "at", "entry.action", "entry.valid_from")


def temporal_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", key: str = "page_id") -> DataFrame:
    """key, host, matched (domain of the deciding entry), action, valid_from and kept, for every capture."""
    c = captures.select(F.col(key).alias("capture"), host_of(F.col(url)).alias("host"), F.col(fetched).cast("long").alias("at"))
    asked = c.select("host", "at").dropna().distinct().select("host", "at", F.posexplode(domains_of(F.col("host"))).alias("depth", "domain"))
    hits = asked.join(as_of(asked, intervals(entries)), ["domain", "at"])
    best = hits.groupBy("host", "at").agg(F.min(F.struct("depth", "domain", "action", "valid_from")).alias("best"))
    return c.join(best, ["host", "at"], "left").select(
        F.col("capture").alias(key), "host", F.col("best.domain").alias("matched"), F.col("best.action").alias("action"), F.col("best.valid_from").alias("valid_from"),
        (F.coalesce(F.col("best.action"), F.lit(ALLOW)) != BLOCK).alias("kept"),
    )
