"""N-gram Jaccard self-join by universe partitions and the pigeonhole principle.

A text is the set of its word n-grams (64-bit hashes).  Texts are taken in bands
of sizes; within a band, at most H elements can be in one of two linked sets
and not in the other.  The band's universe is dealt by hash into segments:
``ones`` whose subsets must be equal and ``twos`` that may differ by one element
(found through the subset and its one-deletion neighbourhood).  H differences
leave ``spare`` + 1 segments in agreement at least.  A set whose empty segments
(and single elements of ``twos``) are no more than ``spare`` therefore shares a
segment that has something in it with each set that it links to, and signs no
empty one; the few other sets sign all of theirs.  So no link is lost, and no
signature is shared for being empty.  How many segments of each kind a band has
is allocated by cost: bytes that it writes, within a limit for each element,
against the rows that meet by chance, from the number of texts in the band.

Equal sets are collapsed before they are signed.  Signatures are moved once, as
packed rows of a bucket (a range of signatures), in as many waves as it takes
for one not to exceed WAVE of the texts' bytes.  Sets that share a signature are
candidates; a parity sketch bounds their difference from below, and what is
left is verified exactly on the sets.  Pairs of one component need no further
verification, since the result is the components.  A signature shared by more
than GROUP sets gives each set's pair with the least one only; pairs between the
components that remain in it are then found from the sketches, for each pair of
bounded blocks in a task of its own.  Where many sets of one block of texts share
a signature, they are paired with their least one before the exchange, and only
that one goes to the signature's bucket.

Words are split at space and TAB to CR after A-Z are lower-cased.  With fewer
than n words the whole sequence is the one shingle; a null text or one without
words has the empty set and is linked with nothing.  Copies link.  Rows that
repeat a doc_id count as that document.  A row without doc_id has the component
of a document with the same set, or none.  An empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enclosa.llm.common import Shared, partitions
from enclosa.llm.components import components
from enclosa.llm.textblocks import NOT_SPACE, blocks, by_row, give_back, lower_ascii, mix, shingle_hashes, word_hashes, word_spans

N, PERCENT = 4, 85
#: Sizes of a band differ by this factor at most; bits of the parity sketch for each element; largest group whose pairs are all compared.
BAND, SKETCH, GROUP = 1.5, 2, 48
#: Sets in a block of a larger group, and bytes of their sketches.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Ids that are broadcast: 8 MB of numbers.
BROADCAST = 1 << 20
#: Bytes of a signature in the exchange, as measured; signatures for each element of a set at most; what writing one costs against comparing two rows that meet.
ROW_BYTES, ROWS, ROW_COST = 8.5, 0.75, 8.0
#: Bytes of text of an element, the share of the texts' bytes that a wave of signatures may have, and signatures of a bucket.
ELEMENT, WAVE, BUCKET = 6, 0.75, 1 << 18
#: Least signatures of a set that its rows in large groups carry, and the share (one in so many) of these groups that the first look takes.
FEW, LOOK = 8, 16
#: Bytes of texts that are signed together, and sets of these that may share a signature before they are paired on the spot.
SIGNED, NEAR = 1 << 20, 16


def overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The least intersection with which sets of these sizes link: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def bands(largest: int, factor: float = BAND) -> list[int]:
    """Lower bounds of the bands, up to beyond ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * factor)))
    return out


def apart(low: int, high: int, percent: int = PERCENT) -> int:
    """The most elements in one and not in the other of two linked sets, of which the smaller has low <= a < high."""
    top = 0
    for a in range(low, high) if high - low < 4000 else (low, high - 1):
        b = a * 100 // percent
        top = max(top, a + b - 2 * overlap(a, b, percent), 2 * a - 2 * overlap(a, a, percent), a + max(a, b - 1) - 2 * overlap(a, max(a, b - 1), percent))
    return top + 2 if high - low >= 4000 else top


def spare(ones: int, twos: int, most: int) -> int:
    """How many segments beyond one agree at least after ``most`` differences; negative where none may."""
    return (ones - most + twos if most <= ones else twos - (most - ones) // 2) - 1


def _beyond(mean: float, k: int) -> float:
    """P(X > k) for a Poisson variable."""
    if mean <= 0:
        return 0.0
    term, total = math.exp(-min(mean, 700.0)), 0.0
    for i in range(k + 1):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1 - total)


def signed(ones: int, twos: int, size: float) -> float:
    """Signatures of a set of this size."""
    return ones + twos * (1 + size / (ones + twos))


def allocate(low: int, high: int, texts: int, percent: int = PERCENT) -> tuple[int, int]:
    """(ones, twos) of the band of sizes low <= a < high, whose larger sets may be up to a * 100 / percent.

    The cost is of the signatures, and of three kinds of pairs that meet without
    being alike: sets with more empty segments than ``spare``, and sets of which
    a segment has nothing but a passage that a third of all texts share.  Twos
    hold more elements, which makes such segments rarer, but write one
    signature for each; ROWS signatures for each element are the limit, unless
    no allocation has as few.
    """
    most = apart(low, high, percent)
    if not most:
        return 1, 0
    size = (low + high) / 2
    best = None
    for twos in sorted({0, *(int(1.4**k) for k in range(40) if int(1.4**k) <= (most + 2) // 2), (most + 2) // 2}):
        for slack in (0, 1, 2, 3, 4, 6, 8, 11, 15, 20, 30, 45, 70, 110, 170):
            ones = max(0, most + 1 - 2 * twos) + slack
            if slack > most + 2 or (free := spare(ones, twos, most)) < 0:
                continue
            m = ones + twos
            c = low / m
            empty = math.exp(-min(c, 700))
            odd = 0.0 if m == 1 else _beyond(ones * empty + twos * empty * (1 + c), free)
            passage = (texts / 3) ** 2 / 2 * min(m, 16) / m * (ones * empty**2 + twos * (empty * (1 + c)) ** 2)
            rows = signed(ones, twos, size)
            cost = ROW_COST * texts * rows + (odd * texts) ** 2 / 2 + passage
            key = (max(0.0, rows - ROWS * size - 4), cost)
            if best is None or key < best[0]:
                best = (key, ones, twos)
    return best[1], best[2]


class Plan:
    """Bands and their allocation, as arrays for lookups by size; small whatever the corpus."""

    def __init__(self, low: list[int], texts: list[int], percent: int = PERCENT):
        self.low, self.percent = np.array(low, np.int64), percent
        both = [allocate(low[k], low[k + 1], texts[k], percent) for k in range(len(low) - 1)]
        self.ones, self.twos = np.array([x[0] for x in both]), np.array([x[1] for x in both])
        self.spare = np.array([spare(*x, apart(low[k], low[k + 1], percent)) for k, x in enumerate(both)])

    def schemes(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(which sets, their band): each set in its own band, and in the one below where it can link to a smaller set there."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        least = -(-sizes * self.percent // 100)
        lower = np.flatnonzero((sizes > 0) & (own > 0) & (least < self.low[np.maximum(own, 0)]))
        every = np.flatnonzero(sizes > 0)
        return [(every, own[every]), (lower, own[lower] - 1)]


def sets_of(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by row and hash: (hashes, rows)."""
    low = lower_ascii(data)
    s, e, r = word_spans(low, off, NOT_SPACE)
    w = word_hashes(low, s, e)
    parts_h, parts_r = [], []
    h, at = shingle_hashes(w, r, n)
    parts_h.append(h)
    parts_r.append(r[at])
    count = np.bincount(r, minlength=len(off) - 1)
    for k in range(1, n):
        short = count[r] == k
        h, at = shingle_hashes(w[short], r[short], k)
        parts_h.append(mix(h, 100 + k))
        parts_r.append(r[short][at])
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    o = by_row(h, r)
    h, r = h[o], r[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Sums modulo 2**64 of the values of each index."""
    out = np.zeros(size, np.uint64)
    np.add.at(out, index, values)
    return out


def signatures(h: np.ndarray, rows: np.ndarray, sizes: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) for each segment subset and each one-deletion of it; empty segments (and single elements of twos) as the module says."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    v = mix(h, 11)
    out_s, out_r = [], []
    for which, band in plan.schemes(sizes):
        if not len(which):
            continue
        ones, twos = plan.ones[band], plan.twos[band]
        m = ones + twos
        base = np.concatenate([[0], np.cumsum(m)])
        k = sizes[which]
        own = np.repeat(np.arange(len(which)), k)
        at = np.repeat(start[which] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        seg = (mix(h[at], 12) >> np.uint64(11)).astype(np.int64) % m[own]
        place = base[own] + seg
        total = sums(v[at], place, base[-1])
        of = np.repeat(np.arange(len(which)), m)
        number = np.arange(base[-1]) - base[of]
        label = mix(mix(band.astype(np.uint64), 13)[of] + number.astype(np.uint64), 14)
        held = np.bincount(place, minlength=base[-1])
        weak = held <= (number >= ones[of])
        odd = np.bincount(of, weights=weak, minlength=len(which)) > plan.spare[band]
        signs = (held > 0) | odd[of]
        out_s.append(mix((total + label)[signs], 15))
        out_r.append(which[of[signs]])
        near = np.flatnonzero((seg >= ones[own]) & ((held[place] > 1) | odd[own]))
        out_s.append(mix(total[place[near]] - v[at][near] + label[place[near]], 15))
        out_r.append(which[own[near]])
    return np.concatenate(out_s) if out_s else np.zeros(0, np.uint64), np.concatenate(out_r) if out_r else np.zeros(0, np.int64)


def _binary(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """One binary value of 8-byte numbers for each row."""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off * 8, np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def parity(h: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set, parities of its hashed elements in a power of two of bits, SKETCH times its size at least.

    Two sets differ in no fewer elements than their sketches in bits; a longer
    sketch is brought to a shorter one's length by adding its halves.
    """
    bits = 1 << np.maximum(9, np.ceil(np.log2(np.maximum(1, SKETCH * sizes))).astype(np.int64))
    cut = np.concatenate([[0], np.cumsum(bits)])
    place = cut[rows] + (mix(h, 21) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(cut[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[i // 8 : j // 8] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def folded(x: np.ndarray, n: int) -> np.ndarray:
    """A sketch (the last axis, 8-byte numbers) at n numbers."""
    while x.shape[-1] > n:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def differ(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, n) ^ folded(b, n)).sum())


_SUMMARY = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary, short binary"
_SETS = "doc_id long, own binary"


def summaries(docs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in blocks(b.column(1)):
                h, r = sets_of(data, off, n)
                size = np.bincount(r, minlength=hi - lo)
                whole = [np.frombuffer(x, np.uint64) for x in parity(h, r, size)]
                sketch, short = ([folded(x, len(x) // k).tobytes() for x in whole] for k in (2, 4))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(sums(mix(h, 1), r, hi - lo).view(np.int64)), pa.array(sums(mix(h, 2), r, hi - lo).view(np.int64)),
                     pa.array(sketch, pa.binary()), pa.array(short, pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "sketch", "short"],
                )

    return docs.select(key, text).mapInArrow(part, _SUMMARY)


#: Low bits of a signature that are stored; a bucket is a range of the others, of which there are 2**24 at most.
_LOW = 40
_PACKED = "bucket long, packed binary"


def _planes(sig: np.ndarray, flag: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """15 rows of bytes: 5 of the signature, a flag, the size's logarithm, 8 of the id; equal bytes stand together, which compresses."""
    out = np.empty((15, len(sig)), np.uint8)
    out[:5] = np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)[:, :5].T
    out[5], out[6] = flag, np.minimum(255, 12 * np.log2(np.maximum(size, 1)))
    out[7:] = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, 8).T
    return out


def _unplaned(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (low bits), flags, sizes and ids of packed rows."""
    x = np.concatenate([np.frombuffer(r, np.uint8).reshape(15, -1) for r in rows], axis=1)
    sig = np.zeros((x.shape[1], 8), np.uint8)
    sig[:, :5] = x[:5].T
    return sig.view(np.uint64)[:, 0], x[5], x[6].astype(np.int64), np.ascontiguousarray(x[7:].T).view(np.int64)[:, 0]


def _signed(plan: Plan, n: int, buckets: int, first: int, last: int):
    """Packed signatures of the buckets first <= k < last of (id, text).

    Sets of one block that share a signature NEAR times over are packed apart, in
    a bucket below zero, and the least of them alone is flagged and goes to the
    signature's own bucket.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_numpy()
            for lo, hi, data, off in blocks(b.column(1), SIGNED):
                h, r = sets_of(data, off, n)
                size = np.bincount(r, minlength=hi - lo)
                sig, of = signatures(h, r, size, plan)
                bucket = ((sig >> np.uint64(_LOW)) * np.uint64(buckets) >> np.uint64(64 - _LOW)).astype(np.int64)
                own = (bucket >= first) & (bucket < last)
                sig, of, bucket = sig[own], of[own], bucket[own]
                flag, names, rows = np.zeros(len(sig), np.uint8), [], []
                order = np.sort(sig)
                many = np.unique(order[NEAR:][order[NEAR:] == order[:-NEAR]])
                if len(many):
                    at = np.flatnonzero(np.isin(sig, many))
                    at = at[np.lexsort((ids[lo + of[at]], sig[at]))]
                    flag[at[np.flatnonzero(np.concatenate([[True], sig[at[1:]] != sig[at[:-1]]]))]] = 1
                    names.append(-1 - int(many[0] % np.uint64(buckets)))
                    rows.append(bucket[at].astype("<i8").tobytes() + _planes(sig[at], flag[at], size[of[at]], ids[lo + of[at]]).tobytes())
                    stays = np.ones(len(sig), bool)
                    stays[at] = flag[at] > 0
                    sig, of, bucket, flag = sig[stays], of[stays], bucket[stays], flag[stays]
                # Buckets are ranges of signatures; within one, rows in order of the text keep bytes of ids together.
                o = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
                bucket = bucket[o]
                planes = _planes(sig[o], flag[o], size[of[o]], ids[lo + of[o]])
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(o) else np.zeros(1, np.int64)
                names += bucket[cut[:-1]].tolist()
                rows += [planes[:, i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.binary())], ["bucket", "packed"])

    return part


_MEET = "a long, b long, sig long"


def _met(sig: np.ndarray, flag: np.ndarray, size: np.ndarray, ids: np.ndarray, far: float, star: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share a signature (sig null); for a long or flagged run, or with ``star``, its pairs with the least id, and (id, null, sig) for its members."""
    o = np.lexsort((ids, sig))
    sig, flag, size, ids = sig[o], flag[o], size[o], ids[o]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    flagged = np.maximum.reduceat(flag, first)
    length = np.add.reduceat(fresh.astype(np.int64), first)
    sig, size, ids = sig[fresh], size[fresh], ids[fresh]
    first = np.cumsum(length) - length
    long = (length > GROUP) | (flagged > 0) | star
    pairs = []
    for n in np.unique(length[(length > 1) & ~long]):
        f = first[(length == n) & ~long]
        i, j = np.triu_indices(int(n), 1)
        step = max(1, 500_000 // len(i))
        for at in range(0, len(f), step):
            g = f[at : at + step, None]
            p, q = (g + i).ravel(), (g + j).ravel()
            ok = np.abs(size[p] - size[q]) <= far
            pairs.append(np.unique(np.stack([ids[p[ok]], ids[q[ok]]]), axis=1))
    inside = np.repeat(long & ((length > 1) | (flagged > 0)), length)
    least, other = np.repeat(ids[first], length)[inside], ids[inside]
    ok = (least != other) & (np.abs(np.repeat(size[first], length)[inside] - size[inside]) <= far)
    pairs.append(np.unique(np.stack([least, other])[:, ok], axis=1))
    u = np.unique(np.concatenate(pairs, axis=1), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1]), pa.nulls(u.shape[1], pa.int64())], ["a", "b", "sig"])
    yield pa.RecordBatch.from_arrays([pa.array(ids[inside]), pa.nulls(int(inside.sum()), pa.int64()), pa.array(sig[inside].view(np.int64))], ["a", "b", "sig"])


def _meet(percent: int):
    far = 12 * math.log2(100 / percent) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of packed rows sorted by bucket; one bucket is held."""
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                sig, *rest = _unplaned(held)
                yield from _met(sig | np.uint64(now << _LOW), *rest, far, False)

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = x.as_buffer().to_pybytes()
                if k < 0:
                    n = len(raw) // 23
                    sig, *rest = _unplaned([raw[8 * n :]])
                    yield from _met(sig | (np.frombuffer(raw[: 8 * n], "<u8") << np.uint64(_LOW)), *rest, far, True)
                    continue
                if k != now:
                    yield from out()
                    now, held = k, []
                held.append(raw)
        yield from out()
        give_back()

    return part


def _sketched(percent: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (a, b, sizes, sketches), the pairs that may link."""
        for t in batches:
            if t.num_rows:
                sa, sb = t.column(2).to_numpy(), t.column(3).to_numpy()
                most = sa + sb - 2 * -(-percent * (sa + sb) // (100 + percent))
                apart = np.array([differ(x, y) for x, y in zip(t.column(4).to_pylist(), t.column(5).to_pylist(), strict=True)])
                ok = (apart <= most) & (100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok))

    return part


def _verified(percent: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (a, b, sets), the pairs that link."""
        for t in batches:
            ok = np.zeros(t.num_rows, bool)
            for k in range(t.num_rows):
                x, y = (np.frombuffer(t.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok))

    return part


def _block_pairs(hot: DataFrame) -> DataFrame:
    """``hot`` (sig, id, size, component, sketch, n, most) with pair and side in place of n and most.

    A sig's n sets, of ``most`` elements at most, are dealt by hash into blocks of
    about BLOCK sets or BLOCK_BYTES of sketches; a set has a row for each block
    that its own is compared with, as side 0 (also with itself) or 1.
    """
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / F.greatest(F.lit(64), F.col("most") * SKETCH / 4))))
    hot = hot.withColumn("k", F.ceil(F.col("n") / rows).cast("long")).withColumn("own", F.pmod(F.xxhash64("id", "sig"), F.col("k")))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    pair = (F.least("own", "other") * F.col("k") + F.greatest("own", "other")).alias("pair")
    side = F.when(F.col("own") > F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(-1).alias("side")
    return hot.select("sig", "id", "size", "component", "sketch", pair, side, *(c for c in hot.columns if c == "few"))


def _left_over(percent: int, best: bool = False):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (sig, id, size, component, sketch, pair, side) sorted by sig, pair and side, pairs of one sig and of different components that may link.

        With ``best``, of each set's pairs within two blocks only the one whose sketches are the most alike.  Where rows
        carry ``few``, each set's least signatures, a pair that has a lesser one in common is left to that.  One block is held, and what it is compared with is read batch by batch;
        a block that is compared with itself (side -1) is held as it is read.
        """
        now, held = None, []

        def elsewhere(x: np.ndarray, y: np.ndarray, sig: int) -> np.ndarray:
            """For rows of signatures, whether one below ``sig`` is in both."""
            out = np.zeros(len(x), bool)
            for k in range(x.shape[1]):
                out |= ((x[:, k, None] == y) & (y < sig)).any(1)
            return out

        def compare(x: tuple, y: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(place in y, id in x, bits to spare) of pairs that may link, for some of x at a time."""
            (i, s, c, k, u), (_, t, d, m, v) = x, y
            n = min(k.shape[1], m.shape[1])
            k, m = folded(k, n), folded(m, n)
            step = max(1, min(256, (16 << 20) // max(1, 8 * n * len(m))))
            for lo in range(0, len(i), step):
                sl = slice(lo, lo + step)
                both = s[sl, None] + t[None, :]
                ok = (c[sl, None] != d[None, :]) & (100 * np.minimum(s[sl, None], t[None, :]) >= percent * np.maximum(s[sl, None], t[None, :]))
                p, q = np.nonzero(ok)
                if len(p):
                    left = both[p, q] - 2 * -(-percent * both[p, q] // (100 + percent)) - np.bitwise_count(k[sl][p] ^ m[q]).sum(1)
                    good = np.flatnonzero(left >= 0)
                    if u.shape[1]:
                        good = good[~elsewhere(u[sl][p[good]], v[q[good]], now[0])]
                    yield q[good], i[sl][p[good]], left[good]

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def against(others: list, piece: tuple) -> Iterator[pa.RecordBatch]:
            most, who = np.full(len(piece[0]), -1), np.zeros(len(piece[0]), np.int64)
            for h in others:
                for q, ids, left in compare(h, piece):
                    if not best:
                        if len(q):
                            yield pairs(ids, piece[0][q])
                        continue
                    o = np.argsort(left, kind="stable")  # of several for one set, the last assignment stays
                    q, ids, left = q[o], ids[o], left[o]
                    more = left > most[q]
                    most[q[more]], who[q[more]] = left[more], ids[more]
            if best and (most >= 0).any():
                yield pairs(piece[0][most >= 0], who[most >= 0])

        for b in batches:
            v = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (0, 5, 6)])
            cut = np.concatenate([[0], np.flatnonzero((v[:, 1:] != v[:, :-1]).any(0)) + 1, [v.shape[1]]])
            for first, last in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for lo in range(first, last, 1024):
                    some = b.slice(lo, min(1024, last - lo))
                    key, side = (int(v[0, lo]), int(v[1, lo])), int(v[2, lo])
                    if key != now:
                        now, held = key, []
                    own = [np.frombuffer(x.as_buffer(), np.uint64) for x in some.column(4)]
                    n = min(map(len, own))
                    few = np.full((len(own), FEW if b.num_columns > 7 else 0), np.iinfo(np.int64).max)
                    for r, x in enumerate(some.column(7) if b.num_columns > 7 else ()):
                        few[r, : len(x)] = x.values.to_numpy()
                    piece = (*(some.column(c).to_numpy() for c in (1, 2, 3)), np.stack([folded(x, n) for x in own]), few)
                    if side != 0:
                        yield from against([*held, piece] if side == -1 else held, piece)
                    if side != 1:
                        held.append(piece)

    return part


def _sets(docs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in blocks(b.column(1)):
                h, r = sets_of(data, off, n)
                cut = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=hi - lo))]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), _binary(h, cut)], ["doc_id", "own"])

    return docs.select(key, text).mapInArrow(part, _SETS)


def verify(pairs: DataFrame, docs: DataFrame, text: str, key: str, n: int, percent: int, shared: Shared) -> DataFrame:
    """The linked pairs among (a, b); only texts of pairs are turned into sets."""
    ids = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct()
    ids = shared.keep(ids, "ids")
    hint = F.broadcast if ids.count() <= BROADCAST else lambda d: d  # a longer list is joined by sorting
    some = _sets(docs.select(key, text).join(hint(ids), key, "left_semi"), text, key, n)
    left = some.select(F.col("doc_id").alias("a"), F.col("own").alias("x"))
    right = some.select(F.col("doc_id").alias("b"), F.col("own").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long")


def _planned(classes: DataFrame, least: int, percent: int) -> tuple[Plan, int, int]:
    """The plan for these sets, buckets and waves; what comes to the driver is one number for each band."""
    largest = classes.agg(F.max("n_shingles")).first()[0] or 1
    low = bands(int(largest))
    band = sum((F.col("n_shingles") >= x).cast("int") for x in low[1:]) if len(low) > 1 else F.lit(0)
    lower = F.ceil(F.col("n_shingles") * percent / 100) < F.element_at(F.array(*map(F.lit, low)), F.col("band") + 1)
    found = classes.withColumn("band", band).groupBy("band", lower.alias("lower")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).collect()
    texts = [0] * (len(low) - 1)
    for r in found:
        texts[r["band"]] += r["n"]
        if r["lower"] and r["band"]:
            texts[r["band"] - 1] += r["n"]
    plan = Plan(low, texts, percent)
    rows = sum(r["n"] * signed(int(plan.ones[k]), int(plan.twos[k]), r["size"] / r["n"]) for r in found for k in {r["band"], r["band"] - 1 if r["lower"] and r["band"] else r["band"]})
    waves = max(1, math.ceil(rows * ROW_BYTES / (WAVE * ELEMENT * max(1, sum(r["size"] for r in found)))))
    return plan, min(1 << 64 - _LOW, max(least, waves, math.ceil(rows / BUCKET))), waves


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    component_id is the least doc_id reachable by links, the row's own included.
    """
    spark = docs.sparkSession
    shared = Shared(spark, "set-join")
    every = shared.keep(summaries(docs, text, key, n), "sets")
    same = ["n_shingles", "h1", "h2"]
    classes = shared.keep(every.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"), "classes")
    plan, buckets, waves = _planned(classes, partitions(spark), percent)
    ids = classes.select(F.col("id").alias(key)).distinct()
    hint = F.broadcast if classes.count() <= BROADCAST else lambda d: d  # a longer list is joined by sorting
    some = docs.select(F.col(key).cast("long").alias(key), text).join(hint(ids), key, "left_semi")
    met = None
    for w in range(waves):
        packed = some.mapInArrow(_signed(plan, n, buckets, buckets * w // waves, buckets * (w + 1) // waves), _PACKED)
        one = packed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(percent), _MEET)
        one = shared.keep(one, "met")
        shared.release()
        met = one if met is None else met.unionByName(one)

    known = every.where("doc_id IS NOT NULL").select(F.col("doc_id"), F.col("n_shingles").alias("size"), "sketch", "short")
    # A quarter of a sketch tells most pairs apart; groups of many sets take a half, which leaves fewer.
    brief, known = known.drop("sketch"), known.drop("short")
    pairs = met.where("sig IS NULL").select("a", "b").distinct()
    pairs = pairs.join(brief.toDF("a", "sa", "ka"), "a").join(brief.toDF("b", "sb", "kb"), "b")
    pairs = shared.keep(pairs.select("a", "b", "sa", "sb", "ka", "kb").mapInArrow(_sketched(percent), "a long, b long"), "pairs")
    shared.release()

    # Each set against its least candidate first; most pairs are then within a component.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = shared.keep(verify(first, docs, text, key, n, percent, shared), "links")
    shared.release()
    label = shared.keep(components(links, shared), "components")
    links, label = _rest(pairs.join(first, ["a", "b"], "left_anti"), links, label, docs, shared, text, key, n, percent)

    # Signatures of many sets: what is still in several components there.  First, in some of them, each set's
    # most alike partner, since most pairs are within a component then; what remains is compared in full.
    members = shared.keep(met.where("sig IS NOT NULL").select("sig", F.col("a").alias("id")).distinct(), "members")
    few = members.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FEW).alias("few"))
    known = shared.keep(known.join(few, F.col("doc_id") == F.col("id")).select("id", "size", "sketch", "few"), "hot")
    for best in (True, False):
        some = members.where(F.pmod(F.xxhash64("sig"), F.lit(LOOK)) == 0) if best else members
        hot = some.join(label, "id", "left").join(known.drop("few") if best else known, "id").withColumn("component", F.coalesce("component", "id"))
        hot = shared.keep(hot, "compared")
        mixed = hot.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.max("size").alias("most")).where("lo < hi").select("sig", "n", "most")
        blocks_of = _block_pairs(hot.join(mixed, "sig")).repartition(partitions(spark), "sig", "pair").sortWithinPartitions("sig", "pair", "side")
        more = blocks_of.mapInArrow(_left_over(percent, best), "a long, b long").distinct()
        links, label = _rest(more, links, label, docs, shared, text, key, n, percent)
        shared.drop(hot)
        shared.release()

    own = every.select("doc_id", *same).join(classes, same, "left")
    return shared.finish(own.join(label, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id")))


def _rest(pairs: DataFrame, links: DataFrame, label: DataFrame, docs: DataFrame, shared: Shared, text: str, key: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and components once the pairs between different components are verified."""
    a = label.toDF("a", "ca")
    b = label.toDF("b", "cb")
    apart = pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    apart = shared.keep(apart, "apart")
    if apart.isEmpty():
        return links, label
    found = shared.keep(verify(apart, docs, text, key, n, percent, shared), "found")
    if found.isEmpty():
        return links, label
    links = links.unionByName(found)
    return links, shared.keep(components(links, shared), "components")
