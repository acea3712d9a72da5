"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item of n words is compared with the windows of n words of
every document.  The similarity is the weight of the item's distinct shingles
that the window has over the weight of all of them.  A shingle weighs more the
fewer items have it.

Windows in which all shingles of items of n words together weigh too little for any
of these items are passed over, which is exact.  The others get a SimHash of
these shingles, each once, whose planes are scaled by the square root of the
weight: item and window are then vectors whose cosine is the square root of the
similarity, as long as the window holds no shingles of other items.  A
fingerprint has two blocks of 64 bits.  Fingerprints within 2 * RADIUS bits
are within RADIUS in one block, and the index returns all items for which that
holds.  At a similarity of 0.8 one bit in seven differs (19 of 128, with a
deviation of 4), against 64 of 128 for unrelated ones, so 46 bits lose next to
nothing (tests measure it).  The exact similarity verifies the candidates, and
each text and item gets its best window.  ``distance`` is the bits between the
item's fingerprint and that of those of its shingles that the window has.

Texts are lower-cased by Unicode's rules; words are runs of letters, digits and
everything beyond ASCII.  Items with fewer than SHINGLE words have their whole word sequence as one
shingle; items without words match nothing.  Null texts are empty.  Items that
repeat an item_id give one match of a text, the best; those without one count as
one.  Repeated rows each give their own matches; rows without doc_id give matches
without one.  An empty table of either kind gives no matches.  Other columns are ignored.

Items are sent to the executors in blocks of at most ITEM_BYTES of text; a larger
benchmark takes several passes over the documents, whose results are united.
Weights are of the whole benchmark, so blocks do not change what matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enclosa.llm.common import Shared
from enclosa.llm.textblocks import blocks, mix, shingle_hashes, word_hashes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of 64 bits of a fingerprint, and bits that may differ in one of them.
BLOCKS, RADIUS = 2, 23
#: The same radius by bytes: of eight, one differs in no more than two bits.
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // 8
ITEM_BYTES = 16 << 20
#: Windows, and pairs of windows and items, that are looked at together.
TOGETHER = 2000
MATCHES = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"
#: Words are runs of letters and digits: ASCII punctuation and spaces part them.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def planes(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a fingerprint, for each hash."""
    bits = [np.unpackbits(mix(h, 31 + k).view(np.uint8).reshape(-1, 8), axis=1) for k in range(BLOCKS)]
    return np.concatenate(bits, axis=1).astype(np.int32) * 2 - 1


def scale(weights: np.ndarray) -> np.ndarray:
    """Whole numbers in proportion to the square roots, so that sums do not depend on their order."""
    return np.round(4096 * np.sqrt(weights)).astype(np.int32)


def fingerprints(h: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash (BLOCKS numbers) of each run of shingles; runs begin at ``first`` and none is empty."""
    total = np.add.reduceat(planes(h) * scale(weights)[:, None], first, axis=0)
    return np.packbits(total > 0, axis=1).view(np.uint64)


def within(prints: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, question) for all of ``prints`` within RADIUS in a block and 2 * RADIUS in all.

    A block is one number, so each asks for one comparison; the other blocks are
    looked at only where one is within RADIUS.
    """
    near = np.bitwise_count(prints[:, 0, None] ^ asked[None, :, 0]) <= RADIUS
    for k in range(1, BLOCKS):
        near |= np.bitwise_count(prints[:, k, None] ^ asked[None, :, k]) <= RADIUS
    p, q = np.nonzero(near)
    ok = np.bitwise_count(prints[p] ^ asked[q]).sum(1) <= BLOCKS * RADIUS
    return p[ok], q[ok]


def item_shingles(text: str | None) -> tuple[int, int, np.ndarray] | None:
    """Words, words of a shingle and shingle hashes of an item; None without words."""
    low = pc.utf8_lower(pa.scalar(text or "", pa.string())).as_py()
    x = np.frombuffer(low.encode(), np.uint8)
    s, e, r = word_spans(x, np.array([0, len(x)]), _WORD)
    if not len(s):
        return None
    k = min(SHINGLE, len(s))
    return len(s), k, shingle_hashes(word_hashes(x, s, e), r, k)[0]


class Items:
    """Shingles, weights and fingerprints of a block of items, by their numbers of words."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY, counts: tuple[np.ndarray, np.ndarray] | None = None):
        """``counts``: the shingles that several items of the whole benchmark have, and how many; without it, these items are all."""
        self.similarity = similarity
        found = [(i, n, k, np.unique(h)) for i, t in zip(ids, texts, strict=True) if (x := item_shingles(t)) for n, k, h in (x,)]
        known, number = np.unique(np.concatenate([h for *_, h in found] or [np.zeros(0, np.uint64)]), return_counts=True)
        if counts is not None:
            number[np.searchsorted(known, counts[0])] = counts[1]
        weight = 1 / (1 + np.log(number))
        self.groups: list[dict] = []
        for n, k in sorted({x[1:3] for x in found}):
            some = [x for x in found if x[1:3] == (n, k)]
            flat = np.concatenate([x[3] for x in some])
            size = np.array([len(x[3]) for x in some])
            every, at = np.unique(flat, return_inverse=True)
            w = weight[np.searchsorted(known, every)]
            first = np.cumsum(size) - size
            of = np.repeat(np.arange(len(some)), size)
            self.groups.append({
                "n": n, "k": k, "ids": [x[0] for x in some], "all": every, "weights": w, "member": of * len(every) + at,
                "total": np.add.reduceat(w[at], first), "prints": fingerprints(flat, w[at], first)})
        #: For each length of shingles, the hashes that items have and (CSR) the groups and places there that each has.
        self.any: dict[int, tuple] = {}
        for k in {g["k"] for g in self.groups}:
            own = [(j, g) for j, g in enumerate(self.groups) if g["k"] == k]
            flat = np.concatenate([g["all"] for _, g in own])
            group = np.concatenate([np.full(len(g["all"]), j) for j, g in own])
            place = np.concatenate([np.arange(len(g["all"])) for _, g in own])
            o = np.lexsort((group, flat))
            hashes, first = np.unique(flat[o], return_index=True)
            may = np.zeros(1 << 20, bool)
            may[hashes >> np.uint64(44)] = True
            self.any[k] = hashes, np.append(first, len(o)), group[o], place[o], may

    def hits(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, group, place in the group's shingles) for each hash that items have."""
        hashes, first, group, place, may = self.any[k]
        at = np.flatnonzero(may[h >> np.uint64(44)])
        own = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        same = hashes[own] == h[at]
        at, own = at[same], own[same]
        many = first[own + 1] - first[own]
        each = _ranges(first[own], many)
        return np.repeat(at, many), group[each], place[each]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each range of this size, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _windows(g: dict, pos: np.ndarray, which: np.ndarray, row: np.ndarray, words: np.ndarray, similarity: float) -> tuple | None:
    """Of hits (sorted by pos), (starts of windows that weigh enough, hits of each as ranges, begins of the hits).

    A hit counts for the windows that hold it and no earlier hit of its shingle.
    """
    span = g["n"] - g["k"] + 1
    o = np.lexsort((pos, which, row))
    again = np.concatenate([[False], (which[o][1:] == which[o][:-1]) & (row[o][1:] == row[o][:-1])])
    before = np.full(len(pos), -1)
    before[o[again]] = pos[o[np.flatnonzero(again) - 1]]
    begin = np.maximum(np.maximum(pos - span + 1, words[row]), before + 1)
    end = np.minimum(pos, words[row + 1] - g["n"]) + 1
    ok = begin < end
    if not ok.any():
        return None
    b, e, w = begin[ok], end[ok], g["weights"][which[ok]]
    ob, oe = np.argsort(b, kind="stable"), np.argsort(e, kind="stable")
    starts = np.unique(b)
    opened = np.cumsum(w[ob])[np.searchsorted(b[ob], starts, "right") - 1]
    closed = np.concatenate([[0], np.cumsum(w[oe])])[np.searchsorted(e[oe], starts, "right")]
    starts = starts[opened - closed >= similarity * g["total"].min() - 1e-6]
    lo = np.searchsorted(pos, starts)
    return starts, lo, np.searchsorted(pos, starts + span) - lo, np.where(ok, begin, np.iinfo(np.int64).max)


def matches(items: Items, data: np.ndarray, off: np.ndarray, seen: list | None = None) -> list[tuple]:
    """(row, item, first word, words, distance, similarity): each item's best window of each text, the first of equal ones.

    The texts are in lower case.  ``seen`` gets (windows, items, candidates) of each search.
    """
    s, e, r = word_spans(data, off, _WORD)
    w = word_hashes(data, s, e)
    words = np.searchsorted(r, np.arange(len(off)))
    out = []
    for k in items.any:
        h, at = shingle_hashes(w, r, k)
        hit, group, place = items.hits(k, h)
        for j in np.unique(group).tolist():
            g = items.groups[j]
            own = group == j
            pos, which = at[hit[own]], place[own]
            found = _windows(g, pos, which, r[pos], words, items.similarity)
            for lo in range(0, len(found[0]) if found else 0, TOGETHER):
                starts, first, size = (x[lo : lo + TOGETHER] for x in found[:3])
                each, of = _ranges(first, size), np.repeat(np.arange(len(starts)), size)
                active = found[3][each] <= starts[of]
                each, of = which[each[active]], of[active]
                begin = np.searchsorted(of, np.arange(len(starts) + 1))
                asked = fingerprints(g["all"][each], g["weights"][each], begin[:-1])
                step = max(1, (1 << 22) // len(starts))
                for q in range(0, len(g["ids"]), step):
                    p, c = within(g["prints"][q : q + step], asked)
                    p = p + q
                    if seen is not None:
                        seen.append((len(starts), min(step, len(g["ids"]) - q), len(p)))
                    for x in range(0, len(p), TOGETHER):
                        out += _verified(items, g, p[x : x + TOGETHER], c[x : x + TOGETHER], each, begin, starts, r, words)
    best: dict[tuple[int, int | None], tuple] = {}
    for m in sorted(out, key=lambda m: (-round(m[-1], 9), m[2])):
        best.setdefault(m[:2], m)
    return sorted(best.values(), key=lambda m: (m[0], m[2], m[3]))


def _verified(items: Items, g: dict, p: np.ndarray, c: np.ndarray, each: np.ndarray, begin: np.ndarray, starts: np.ndarray, r: np.ndarray, words: np.ndarray) -> list[tuple]:
    """The candidates (item p, window c) whose exact similarity is enough; ``each`` has the windows' shingles."""
    size = begin[c + 1] - begin[c]
    upto = np.concatenate([[0], np.cumsum(size)])
    sh, of = each[_ranges(begin[c], size)], np.repeat(np.arange(len(c)), size)
    code = p[of] * len(g["all"]) + sh
    at = np.minimum(np.searchsorted(g["member"], code), len(g["member"]) - 1)
    both = g["member"][at] == code
    sim = np.bincount(of[both], weights=g["weights"][sh[both]], minlength=len(c)) / g["total"][p]
    out = []
    for x in np.flatnonzero(sim >= items.similarity - 1e-12).tolist():
        own = sh[upto[x] : upto[x + 1]][both[upto[x] : upto[x + 1]]]
        seen = fingerprints(g["all"][own], g["weights"][own], np.zeros(1, np.int64))[0]
        row, start = int(r[starts[c[x]]]), int(starts[c[x]])
        out.append((row, g["ids"][p[x]], start - int(words[row]), g["n"], int(np.bitwise_count(seen ^ g["prints"][p[x]]).sum()), round(float(sim[x]), 12)))
    return out


def item_blocks(benchmark: DataFrame, text: str, key: str, size: int = ITEM_BYTES) -> list[int]:
    """How many blocks it takes for none to have much more than ``size`` bytes of items."""
    total = benchmark.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + 64)).first()[0] or 0
    return list(range(max(1, -(-int(total) // size))))


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h) for each distinct shingle of each (block, text)."""
    for b in batches:
        for block, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = item_shingles(t)
            if found:
                h = np.unique(found[2]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block)), pa.array(h)], ["block", "h"])


def shingle_counts(items: DataFrame) -> DataFrame:
    """(block, h, n): shingles that n > 1 items of all blocks have, once for each block that has one of these."""
    own = items.select(F.col("block").cast("long"), "t").mapInArrow(_item_shingles, "block long, h long").groupBy("block", "h").agg(F.count("*").alias("n"))
    own = Shared(items.sparkSession, "decontamination").keep(own, "shingles")
    return own.select("block", "h").join(own.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "h").select("block", "h", "n")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item that it contains: where, and how alike."""
    spark = docs.sparkSession
    number = item_blocks(benchmark, text, item)
    every = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(text, F.lit("")).alias("t"))
    every = every.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(len(number))))
    # The items of a single block are all items; of several, each takes the counts of its shingles over all.
    shared = shingle_counts(every) if len(number) > 1 else None
    out = None
    for k in number:
        some = every.where(F.col("block") == k).orderBy("i", "t").select("i", "t").collect()
        counts = None
        if shared is not None:
            own = shared.where(F.col("block") == k).select("h", "n").toArrow()
            counts = own.column("h").to_numpy().view(np.uint64), own.column("n").to_numpy()
        cast = spark.sparkContext.broadcast(([x["i"] for x in some], [x["t"] for x in some], similarity, counts))

        def part(batches: Iterator[pa.RecordBatch], cast=cast) -> Iterator[pa.RecordBatch]:
            items = Items(*cast.value)
            types = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            for b in batches:
                ids = b.column(0).to_pylist()
                for lo, _, data, off in blocks(pc.utf8_lower(b.column(1))):
                    found = [(ids[lo + m[0]], *m[1:]) for m in matches(items, data, off)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        one = docs.select(F.col(key).cast("long"), text).mapInArrow(part, MATCHES)
        out = one if out is None else out.unionByName(one)
    return out
