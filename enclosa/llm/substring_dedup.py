"""Exact substring deduplication by distributed difference-cover suffix sorting.

Every byte that lies in a string of LENGTH bytes that also starts earlier
(smaller doc_id, or the same document and an earlier start) is removed.

Suffixes are dealt to tasks so that equal prefixes of LENGTH bytes meet: each
start belongs to the least hash among the K-grams of its LENGTH bytes (its
anchor), which depends on these bytes alone.  Neighbouring starts of one anchor
form a context.  Most anchors occur once in the corpus, and nothing equal can
start there; a count by anchor finds these.  Of the other contexts, equal ones
are collapsed to the earliest; those that remain are brought together by anchor,
their suffixes are sorted by the difference-cover algorithm (sample triples
sorted and named, recursion on the names, merge of the remaining suffixes), and
adjacent prefixes are compared.  An anchor with more than HOT different contexts
would make a task large; its contexts are cut again by anchors of more bytes (WIDER),
which equal prefixes share as well, and go the same way.  What stays hot after the
last of these is grouped by its LENGTH bytes, with partial aggregation, which gives the same classes.

No task ever gathers one anchor's rows: counts and minima are aggregated in
part before each shuffle, and what comes back to a document is about that document.
Texts are moved once, into buckets of doc_id, which are read as streams.

A null text is empty.  Texts of less than LENGTH bytes lose nothing.  Rows that
repeat a doc_id and its text are the same document and lose the same; further
texts of a repeated doc_id (all but that of the least hash) are documents that come
after all others, in the order of their hashes.  A row without doc_id comes nowhere in the order, so it loses nothing and takes nothing
from others.  An empty table gives an empty one.  doc_id lies from -2**35 to 2**35 and a text has less than 2**28
bytes; otherwise the query fails with an error.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enclosa.llm.common import Shared, partitions
from enclosa.llm.difference_cover import equal_prefixes
from enclosa.llm.rows import with_rows
from enclosa.llm.textblocks import _TABLE, blocks, give_back, mix, powers

LENGTH, K = 100, 20
START_BITS = 28
#: Contexts of an anchor that are sorted together; bytes of contexts in one suffix array; starts looked at together.
HOT, SORTED, SPAN = 2000, 1 << 19, 1 << 19
#: Bytes of the anchors that cut the contexts of hot ones again.
WIDER = (60, 90)
#: Hot anchors that are broadcast: 8 MB of numbers.
BROADCAST = 1 << 20
_POS = np.uint64(22)


def _ranges(off: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of up to ``span`` bytes; a longer text is cut at multiples of ``span`` from its own start.

    So a context never depends on which texts happen to lie in one block.
    """
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > span:
            for lo in range(int(off[i]), int(off[i + 1]), span):
                yield lo, min(lo + span, int(off[i + 1]))
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(off, off[i] + span, "right")) - 1)
            yield int(off[i]), int(off[j])
            i = j


def contexts(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the starts with ``length`` bytes of one text: (row, first start, last start, anchor hash) of each context."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    w = length - k + 1
    for lo, hi in _ranges(off, SPAN):
        hi = min(hi, len(data) - length + 1)  # starts lo to hi - 1
        if hi <= lo:
            continue
        x = data[lo : hi + length - 1]
        p, ip = powers(len(x) + 1)
        h = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_TABLE[x] * p[:-1], out=h[1:])
        n = len(x) - k + 1
        h = mix((h[k:] - h[:-k]) * ip[:n])
        # Least of w hashes, the leftmost of equal ones: the place is the low end of the key.
        v = (h >> _POS << _POS) | np.arange(n, dtype=np.uint64)
        m, span = v, 1
        while 2 * span <= w:
            m = np.minimum(m[: len(m) - span], m[span:])
            span *= 2
        m = np.minimum(m[: hi - lo], m[w - span : w - span + hi - lo])
        at = (m & np.uint64((1 << 22) - 1)).astype(np.int64)
        start = np.arange(lo, hi)
        row = np.searchsorted(off, start, "right") - 1
        inside = start + length <= off[row + 1]
        start, row, at = start[inside], row[inside], at[inside]
        if not len(start):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        last = np.concatenate([cut[1:] - 1, [len(start) - 1]])
        for o, y in zip(out, (row[cut], start[cut], start[last], h[at[cut]]), strict=True):
            o.append(y)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, kinds, strict=True))


def _positions(ids: np.ndarray, start: np.ndarray, largest: int) -> np.ndarray:
    if len(ids) and (ids.min() < -(1 << 63 - START_BITS) or ids.max() >= 1 << 63 - START_BITS) or largest >= 1 << START_BITS:
        raise ValueError(f"doc_id must lie within +-2**{63 - START_BITS} and a text must have less than 2**{START_BITS} bytes")
    return (ids << START_BITS) | start


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy()
        for lo, _, data, off in blocks(b.column(1)):
            row, first, _, anchor = contexts(data, off)
            pos = _positions(ids[lo + row], first - off[row], int(np.diff(off).max()))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(pos)], ["anchor", "pos"])


def _known(rows: np.ndarray, starts: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each (row, start) is in that row's list."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    v = lists.flatten().to_numpy().astype(np.int64)
    of = lists.value_parent_indices().to_numpy() if hasattr(lists, "value_parent_indices") else pa.compute.list_parent_indices(lists).to_numpy()
    return np.isin((rows << START_BITS) | starts, (of.astype(np.int64) << START_BITS) | v)


def _shared_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, pos) of the contexts whose anchor isn't unique; rows are (id, text, unique starts)."""
    for b in batches:
        ids = b.column(0).to_numpy()
        for lo, hi, data, off in blocks(b.column(1)):
            row, first, last, anchor = contexts(data, off)
            begin = first - off[row]
            more = ~_known(row, begin, b.column(2).slice(lo, hi - lo))
            row, first, last, anchor, begin = (x[more] for x in (row, first, last, anchor, begin))
            raw = data.tobytes()
            for at in range(0, len(row), 20_000):
                s = slice(at, at + 20_000)
                own = [raw[i : j + LENGTH] for i, j in zip(first[s].tolist(), last[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[s].view(np.int64)), pa.array(own, pa.binary()), pa.array(_positions(ids[lo + row[s]], begin[s], 0))], ["anchor", "context", "pos"])


def _flags(own: list[bytes], pos: np.ndarray) -> list[bytes]:
    """For each context, a bit for each start: 1 where the same LENGTH bytes start earlier in one of these contexts."""
    size = np.array([len(x) for x in own])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = size - LENGTH + 1
    which = np.repeat(np.arange(len(own)), n)
    t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cls = equal_prefixes(np.frombuffer(b"".join(own), np.uint8), begin[which] + t, LENGTH)
    where = pos[which] + t
    least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, cls, where)
    later = where > least[cls]
    ends = np.cumsum(n)
    return [np.packbits(later[e - k : e]).tobytes() for e, k in zip(ends, n, strict=True)]


def _sorted_contexts(batches: Iterator[pa.RecordBatch], first: bool = False) -> Iterator[pa.RecordBatch]:
    """(pos, flags) for (anchor, context, pos) sorted by anchor; whole anchors, up to SORTED bytes, share a suffix array.

    With ``first`` the flags are of the starts that have no earlier one, and never left out.
    """
    parts: list[pa.RecordBatch] = []
    held = 0

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows:
            t = pa.Table.from_batches(rows)
            anchor, pos = t.column(0).to_numpy(), t.column(2).to_numpy()
            same = np.concatenate([[False], anchor[1:] == anchor[:-1], [False]])
            several = np.flatnonzero(same[1:] | same[:-1])
            flags = np.full(len(pos), b"", object)
            if len(several):
                flags[several] = _flags(t.column(1).take(several).to_pylist(), pos[several])
            if first:
                n = pa.compute.binary_length(t.column(1)).to_numpy() - LENGTH + 1
                later = (np.unpackbits(np.frombuffer(f, np.uint8), count=k) if f else np.zeros(k, np.uint8) for f, k in zip(flags, n.tolist(), strict=True))
                flags = np.array([np.packbits(1 - x).tobytes() for x in later], object)
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(flags, pa.binary())], ["pos", "flags"])

    last = None
    for b in batches:
        anchor = b.column(0).to_numpy()
        sizes = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset : b.column(1).offset + len(b) + 1]) if len(b) else np.zeros(0)
        cut = np.concatenate([np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), [len(anchor)]]) if len(b) else [0]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if anchor[lo] != last and held >= SORTED // 2:
                yield from flush(parts)
                parts, held = [], 0
            last = anchor[lo]
            parts.append(b.slice(lo, hi - lo))
            held += int(sizes[lo:hi].sum())
    yield from flush(parts)
    give_back()


def _first_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _sorted_contexts(batches, True)


def _parts(k: int):
    """(anchor, context, pos) for (context, pos): its contexts by anchors of ``k`` bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 5000):
                s = b.slice(lo, 5000)
                own, pos = s.column(0).to_pylist(), s.column(1).to_numpy()
                raw, off = b"".join(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
                row, first, last, anchor = contexts(np.frombuffer(raw, np.uint8), off, LENGTH, k)
                cut = [raw[i : j + LENGTH] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(cut, pa.binary()), pa.array(pos[row] + first - off[row])], ["anchor", "context", "pos"])

    return part


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, pos) for each start of (context, pos)."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            s = b.slice(lo, 500)
            own, at = [], []
            for c, p in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                for i in range(len(c) - LENGTH + 1):
                    own.append(c[i : i + LENGTH])
                    at.append(p + i)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(at, pa.int64())], ["window", "pos"])


def _removed(row, first, last, off, unique, outs, kept, n: int) -> np.ndarray:
    """For each byte of a block, whether it goes."""
    begin = first - off[row]
    alone = _known(row, begin, unique)
    later = np.zeros(n + 1, bool)
    of = pa.compute.list_parent_indices(outs).to_numpy().astype(np.int64)
    flat = outs.flatten()
    start, flags = flat.field(0).to_numpy().astype(np.int64), flat.field(1)
    key = (of << START_BITS) | start
    o = np.argsort(key)
    key = key[o]
    own = (row << START_BITS) | begin
    at = np.searchsorted(key, own)
    found = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == own) if len(key) else np.zeros(len(own), bool)
    step = np.zeros(n + 2, np.int64)
    gone = ~alone & ~found
    np.add.at(step, first[gone], 1)
    np.add.at(step, last[gone] + 1, -1)
    later |= np.cumsum(step)[: n + 1] > 0
    stays = np.zeros(n + 1, bool)
    some = kept.flatten()
    begin = off[pa.compute.list_parent_indices(kept).to_numpy().astype(np.int64)] + some.field(0).to_numpy().astype(np.int64)
    for i, bits in zip(begin.tolist(), some.field(1).to_pylist(), strict=True):
        stays[i + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))] = True
    for c in np.flatnonzero(found):
        f = flags[int(o[at[c]])].as_py()
        i, j = first[c], last[c] + 1
        if f is None:
            later[i:j] = ~stays[i:j]
        elif f:
            later[i:j] = np.unpackbits(np.frombuffer(f, np.uint8), count=j - i).astype(bool)
    step = np.zeros(n + LENGTH + 2, np.int64)
    at = np.flatnonzero(later)
    step[at] += 1
    step[at + LENGTH] -= 1
    return np.cumsum(step)[:n] > 0


def _finished(text_out: bool, extra: list[str]):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in blocks(b.column(1)):
                row, first, last, _ = contexts(data, off)
                gone = _removed(row, first, last, off, *(b.column(k).slice(lo, hi - lo) for k in (2, 3, 4)), len(data))
                out = []
                for i in range(hi - lo):
                    g, x = gone[off[i] : off[i + 1]], data[off[i] : off[i + 1]]
                    rest = x[~g].tobytes()
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    out.append((len(x), int(g.sum()), spans, rest.decode("utf-8", "ignore") if text_out else hashlib.sha256(rest).hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols, *(b.column(k).slice(lo, hi - lo) for k in range(5, b.num_columns))], ["doc_id", "n_bytes", "n_removed", "n_spans", "last", *extra])

    return part


def _located(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.shiftright("pos", START_BITS).alias("doc_id"), F.col("pos").bitwiseAND((1 << START_BITS) - 1).cast("int").alias("start"), *more)


def removals(docs: DataFrame, text: str = "text", key: str = "doc_id", text_out: bool = False, extra: list[str] | None = None, unique: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row; with ``text_out`` the remaining ``text`` in place of its hash.

    Bytes of a character that was cut are dropped from ``text``.  Columns named
    in ``extra`` follow.  ``unique`` says that no doc_id has different texts, which is otherwise looked up.
    """
    spark = docs.sparkSession
    named = [F.col(c).alias(f"extra_{k}") for k, c in enumerate(extra or ())]
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *named)
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    more = [f"extra_{k}" for k in range(len(named))]
    rows, odd = (docs, None) if unique else with_rows(spark, docs)
    if odd is None:
        out = _removals(docs, text_out, more)
    else:
        docs = rows.withColumnRenamed("doc_id", "extra_doc").withColumnRenamed("row", "doc_id")
        out = _removals(docs, text_out, [*more, "extra_doc"]).drop("doc_id").withColumnRenamed("extra_doc", "doc_id")
    zero = F.lit(0).cast("long")
    rest = nameless.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        (F.col("text") if text_out else F.sha2(F.col("text").cast("binary"), 256)).alias("last"), *more)
    base = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    every = out.select(*base, "last", *more).unionByName(rest)
    return every.select(*base, F.col("last").alias("text" if text_out else "kept_sha256"), *(F.col(m).alias(c) for m, c in zip(more, extra or (), strict=True)))


def _removals(docs: DataFrame, text_out: bool, extra: list[str]) -> DataFrame:
    """removals() of (doc_id, text and extra columns) without nulls."""
    spark = docs.sparkSession
    shared = Shared(spark, "substring-dedup")
    docs = shared.dealt(docs, "texts", "doc_id")  # texts are moved once; both joins below bring lists to them
    shared.release()
    anchors = docs.select("doc_id", "text").mapInArrow(_anchors, "anchor long, pos long")
    alone = anchors.groupBy("anchor").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where("n = 1")
    unique = shared.keep(_located(alone).groupBy("doc_id").agg(F.collect_list("start").alias("unique")), "unique")
    shared.release()

    none = F.array().cast("array<int>")
    known = docs.join(unique, "doc_id", "left").select("doc_id", "text", F.coalesce("unique", none).alias("unique"))
    found = known.mapInArrow(_shared_contexts, "anchor long, context binary, pos long")
    first = shared.keep(found.groupBy("anchor", "context").agg(F.min("pos").alias("pos")), "contexts")
    shared.release()

    hot = shared.keep(first.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
    # One hot anchor for each HOT contexts at most; a list beyond the bound is joined by sorting.
    bounded = lambda n: F.broadcast if n <= BROADCAST else lambda d: d
    n = hot.count()
    hint = bounded(n)
    cold = first.join(hint(hot), "anchor", "left_anti").select("anchor", "context", "pos")
    flags = shared.keep(cold.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_contexts, "pos long, flags binary"), "flags")
    shared.release()
    many = first.join(hint(hot), "anchor", "left_semi")
    rest, found = many, []
    for k in WIDER if n else ():
        parts = rest.select("context", "pos").mapInArrow(_parts(k), "anchor long, context binary, pos long")
        parts = shared.keep(parts.groupBy("anchor", "context").agg(F.min("pos").alias("pos")), f"parts-{k}")
        still = shared.keep(parts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"), f"hot-{k}")
        n = still.count()
        few = parts.join(bounded(n)(still), "anchor", "left_anti").select("anchor", "context", "pos")
        found.append(few.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(_first_starts, "pos long, flags binary"))
        rest = parts.join(bounded(n)(still), "anchor", "left_semi")
        if not n:
            break
    stays = rest.select("context", "pos").mapInArrow(_windows, "window binary, pos long").groupBy("window").agg(F.min("pos").alias("pos"))
    stays = stays.select("pos", F.lit(b"\x80").alias("flags"))
    for d in found:
        stays = stays.unionByName(d)
    kept = shared.keep(_located(stays, "flags").groupBy("doc_id").agg(F.collect_list(F.struct("start", "flags")).alias("kept")), "kept")
    outs = flags.unionByName(many.select("pos", F.lit(None).cast("binary").alias("flags")))
    outs = shared.keep(_located(outs, "flags").groupBy("doc_id").agg(F.collect_list(F.struct("start", "flags")).alias("outs")), "outs")
    for t in (first, hot, flags):
        shared.drop(t)
    shared.release()

    # The small lists are put together before they meet the texts.
    lists = unique.join(outs, "doc_id", "full").join(kept, "doc_id", "full")
    every = docs.join(lists, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("unique", none).alias("unique"),
        F.coalesce("outs", F.array().cast("array<struct<start:int,flags:binary>>")).alias("outs"), F.coalesce("kept", F.array().cast("array<struct<start:int,flags:binary>>")).alias("kept"), *extra)
    kinds = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, last string", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)])
    out = every.mapInArrow(_finished(text_out, extra), kinds)
    return out if text_out else shared.finish(out)  # a few numbers a document; texts are written by whoever wants them
