"""Packing by Karmarkar-Karp multiway differencing.

Each document becomes token ids and one separator id.  Whole windows of
``window`` ids are cut off first and fill a sequence each; what is left is cut
into pieces of at most PIECE ids.  Blocks of documents pack their pieces on
their own: every piece starts as a partition into k windows of which one is
used; the two partitions of largest imbalance are merged with opposing
imbalances (fullest with emptiest) until one is left, whose windows are nearly
equal.  While the fullest exceeds ``window``, k rises by one.

A block is a hash range of the piece (document, place and checksum of its ids),
so its size does not depend on how rows lie in files.  Blocks are read as sorted
streams and packed in portions of at most PORTION pieces, so that no task holds
more, even where rows repeat one document without end.  Each id lies in exactly
one piece.

A null text is empty and is its separator alone.  Rows that repeat a doc_id, and
rows without one, are packed one by one.  An empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
PIECE = 256
#: Documents in a block on average: about 300 windows of leftovers.
BLOCK_DOCS = 600
#: Pieces that are packed together at most: several blocks' worth.
PORTION = 12_000
SEPARATOR = 0
CACHE = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = f"{PIECES}, sequence_id long, offset long"


#: Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids as little-endian bytes, with a bounded cache of space-separated chunks.

    ``file`` is a byte-level BPE vocabulary in JSON whose ids are in the order of
    its merges, which lets the faster of the two BPE libraries do the merging.

    A token never spans a single space and what comes before it, so each chunk
    with the space in front of it can be encoded alone; texts with runs of
    spaces or a final space are encoded whole.
    """

    def __init__(self, file: str):
        import tiktoken

        vocab = json.loads(Path(file).read_text(encoding="utf-8"))
        byte_of = byte_alphabet()
        special = {t["content"] for t in vocab.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[-1] == " ":
            return self._ids(text)
        chunks = text.split(" ")
        chunks[1:] = [" " + c for c in chunks[1:]]
        cache = self.cache
        try:
            return b"".join([cache[c] for c in chunks])
        except KeyError:
            pass
        new = [c for c in dict.fromkeys(chunks) if c not in cache]
        if len(cache) > CACHE:
            cache.clear()
            new = list(dict.fromkeys(chunks))
        for c in new:
            cache[c] = self._ids(c)
        return b"".join([cache[c] for c in chunks])


def cuts(n: int, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    whole = n - n % window
    out = [(s, window) for s in range(0, whole, window)]
    return out + [(s, min(piece, n - s)) for s in range(whole, n, piece)]


def tokenised(docs: DataFrame, file: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, piece: int = PIECE, ids: bool = False) -> DataFrame:
    """The pieces of every document; with ``ids``, their token ids as well."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(file)
        end = np.asarray([SEPARATOR], dtype="<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                rows, own = [], []
                some = b.slice(lo, 512)
                for doc, t in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    raw = e.encode(t.as_py() or "") + end
                    n = len(raw) // 4
                    for s, k in cuts(n, window, piece):
                        cut = raw[4 * s : 4 * (s + k)]
                        rows.append((doc, s, k, zlib.crc32(cut), n))
                        if ids:
                            own.append(np.frombuffer(cut, "<u4").astype(np.int32))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(own, pa.list_(pa.int32()))] * ids, names + ["ids"] * ids)

    return docs.select(key, text).mapInArrow(part, PIECES + ", ids array<int>" * ids)


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, list[int]]:
    """The window (0 to k - 1) of each size, and the windows' sums, by Karmarkar-Karp differencing.

    A partition is k sums in falling order, each with the tree of its pieces.
    Only its used windows are stored; the others are level with the emptiest.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap: list[tuple] = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, sa, ta = heapq.heappop(heap)
        _, _, sb, tb = heapq.heappop(heap)
        # The fullest of a meets the emptiest of b: b is read from its end.
        meet = max(0, len(sa) + len(sb) - k)
        sums = np.concatenate([sa, sb[: len(sb) - meet]])
        trees = np.concatenate([ta, tb[: len(tb) - meet]])
        if meet:
            # a's last ``meet`` windows meet b's last ``meet`` in opposite order.
            at = np.arange(len(sa) - meet, len(sa))
            other = np.arange(len(sb) - 1, len(sb) - meet - 1, -1)
            sums[at] += sb[other]
            left += ta[at].tolist()
            right += tb[other].tolist()
            trees[at] = np.arange(len(left) - meet, len(left))
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        least = sums[-1] if len(sums) == k else 0
        count += 1
        heapq.heappush(heap, (-(int(sums[0]) - int(least)), count, sums, trees))
    window = np.zeros(n, np.int64)
    sums, trees = (heap[0][2], heap[0][3]) if heap else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for w, t in enumerate(trees.tolist()):
        stack = [t]
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += (left[x], right[x])
    return window, sums.tolist()


def windows(sizes: list[int], capacity: int = WINDOW) -> np.ndarray:
    """The window of each size; as many windows as it takes for none to exceed the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, sums = differencing(sizes, k)
        if not sums or max(sums) <= capacity:
            return window
        k += 1


def _packed(t: pa.Table, block: int, first: int, window: int) -> tuple[pa.Table, int]:
    """A portion of one block with sequence_id, numbered from ``first``, and offset; and the number after the last."""
    length = t.column("length").to_numpy()
    full = length == window
    number = np.zeros(len(length), np.int64)
    number[full] = np.arange(full.sum())
    number[~full] = windows(length[~full].tolist(), window) + full.sum()
    o = np.argsort(number, kind="stable")
    upto = np.cumsum(length[o]) - length[o]
    fresh = np.concatenate([[True], number[o][1:] != number[o][:-1]])
    offset = np.empty(len(length), np.int64)
    offset[o] = upto - np.repeat(upto[fresh], np.diff(np.append(np.flatnonzero(fresh), len(o))))
    out = t.append_column("sequence_id", pa.array((block << 32) + first + number)).append_column("offset", pa.array(offset))
    return out, first + int(number.max()) + 1


def pack(pieces: DataFrame, documents: int, window: int = WINDOW, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``pieces`` with sequence_id and offset; other columns of it stay.

    sequence_id is the block's number times 2**32 plus the window's number in it.
    """
    blocks = max(1, -(-documents // block_docs))
    schema = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",sequence_id:bigint,offset:bigint"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, 0, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, size
            if held:
                t, first = _packed(pa.Table.from_batches(held), now, first, window)
                held, size = [], 0
                yield from t.to_batches()

        for b in batches:
            key = b.column(b.num_columns - 1).to_numpy()
            b = b.select(b.schema.names[:-1])
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist() if len(key) else [0]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if key[lo] != now:
                    yield from out()
                    now, first = int(key[lo]), 0
                while lo < hi:
                    some = b.slice(lo, min(hi - lo, PORTION - size))
                    held.append(some)
                    size, lo = size + len(some), lo + len(some)
                    if size == PORTION:
                        yield from out()
        yield from out()

    # The piece decides on its block, not the document: rows that repeat a document differ in no other way.
    block = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "start", "ids_crc32"), F.lit(blocks)).alias("block")
    dealt = pieces.select("*", block).repartition("block").sortWithinPartitions("block", "doc_id", "start", "length", "ids_crc32")
    return dealt.mapInArrow(part, schema)


def pack_documents(docs: DataFrame, file: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its sequence and offset."""
    return pack(tokenised(docs, file, text, key, window, ids=ids), docs.count(), window)
