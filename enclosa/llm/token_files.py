"""Token counts of flat token files by separator scan.

A flat file is token ids one after another, documents closed by a separator id,
without an index.  It is read in blocks of fixed size that know nothing of
documents.  Each block is searched for separators on its own, vectorised; the
tokens before its first separator and after its last are stitched to the
neighbouring blocks by a prefix scan over the blocks' summaries: a running count
of separators numbers the documents, and a running maximum of the last separator's
position says where the document that a block continues began.

The scan is over one row a block.  It has two levels, chunks of CHUNK blocks and
then the chunks of a file, so that no task scans more than CHUNK rows of a file.

A file without tokens has no documents; tokens after the last separator form a
last document that is marked as open.  Two separators in a row enclose an empty
document, which counts.  No blocks give no documents; other columns of the
blocks are ignored.  Where documents are written, null texts are empty ones, rows
that repeat a doc_id and rows without one are documents each, and an id that does
not fit the file's width is an error.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 1 << 16
CHUNK = 1024
#: Bytes of a file that one row stands for.
RANGE = 64 << 20
BLOCKS = "file_id long, block long, tokens binary"
SPANS = "file_id long, document long, start long, n_tokens long, closed boolean"


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files that ``path`` (a file, folder or pattern) stands for."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.globStatus(p) or ():
        for f in fs.listStatus(s.getPath()) if s.isDirectory() else (s,):
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def from_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the files at ``path`` (ids little-endian, ``width`` bytes each); file_id is a hash of the file's path.

    Files on a mounted file system are read in ranges of RANGE bytes, each a row
    of its own, so that one large file takes many tasks.  From other stores a
    file is one row, for which Spark's bound is 2 GB.  A trailing part of an id
    is an error.
    """
    files = _listed(spark, path)
    for name, size in files:
        if size % width:
            raise ValueError(f"{name}: {size} bytes are not whole ids of {width} bytes")
    step = width * block_tokens
    each = max(1, RANGE // step)
    mounted = all(name.startswith("file:") for name, _ in files)
    if mounted:
        pieces = [(name, k, min(k + each * step, size)) for name, size in files for k in range(0, size, each * step)]
        d = spark.createDataFrame(pieces, "path string, first long, last long").repartition(max(1, min(len(pieces), 10_000)), "path", "first")

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for f, name, first, last in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    with open(urllib.parse.unquote(urllib.parse.urlparse(name).path), "rb") as file:
                        file.seek(first)
                        for at in range(first, last, step):
                            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([at // step], pa.int64()), pa.array([file.read(min(step, last - at))], pa.binary())], ["file_id", "block", "tokens"])

        return d.select(F.xxhash64("path").alias("file_id"), "path", "first", "last").mapInArrow(part, BLOCKS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                buf = memoryview(raw.as_buffer() or b"")
                for k, at in enumerate(range(0, len(buf), step)):
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([k], pa.int64()), pa.array([bytes(buf[at : at + step])], pa.binary())], ["file_id", "block", "tokens"])

    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file_id"), "content").mapInArrow(whole, BLOCKS)


def found(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """file_id, block, n (tokens), seps (positions of separators in the block, as a binary of 4-byte numbers)."""
    kind = np.dtype(f"<u{width}")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, first, last, count, seps = [], [], [], [], []
            for raw in b.column(2):
                t = np.frombuffer(raw.as_buffer() or b"", kind)
                at = np.flatnonzero(t == separator).astype("<i4")
                n.append(len(t))
                count.append(len(at))
                last.append(int(at[-1]) if len(at) else None)
                seps.append(at.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(last, pa.int64()), pa.array(seps, pa.binary())], ["file_id", "block", "n", "count", "last", "seps"])

    return blocks.select("file_id", "block", "tokens").mapInArrow(part, "file_id long, block long, n long, count long, last long, seps binary")


def stitched(summaries: DataFrame) -> DataFrame:
    """``summaries`` with base (tokens before the block), document (separators before it), since (tokens up to the last separator before it) and final."""
    s = summaries.withColumn("chunk", F.expr(f"block div {CHUNK}"))
    inside = Window.partitionBy("file_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    s = s.withColumn("n0", zero(F.sum("n").over(inside))).withColumn("c0", zero(F.sum("count").over(inside)))
    s = s.withColumn("l0", F.max(F.col("n0") + F.col("last") + 1).over(inside))
    chunks = s.groupBy("file_id", "chunk").agg(F.sum("n").alias("n"), F.sum("count").alias("count"), F.max(F.col("n0") + F.col("last") + 1).alias("last"))
    over = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("n1", zero(F.sum("n").over(over))).withColumn("c1", zero(F.sum("count").over(over)))
    chunks = chunks.withColumn("l1", F.max(F.col("n1") + F.col("last")).over(over)).withColumn("more", F.lead("chunk").over(Window.partitionBy("file_id").orderBy("chunk")).isNotNull())
    s = s.withColumn("next", F.lead("block").over(Window.partitionBy("file_id", "chunk").orderBy("block")))
    s = s.join(chunks.select("file_id", "chunk", "n1", "c1", "l1", "more"), ["file_id", "chunk"])
    return s.select(
        "file_id", "block", "n", "count", "seps", (F.col("n0") + F.col("n1")).alias("base"), (F.col("c0") + F.col("c1")).alias("document"),
        zero(F.coalesce(F.col("l0") + F.col("n1"), F.col("l1"))).alias("since"), (F.col("next").isNull() & ~F.col("more")).alias("final"),
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            f, n, seps, base, doc, since, final = (b.column(c)[k].as_py() for c in range(7))
            end = base + np.frombuffer(seps, "<i4").astype(np.int64)
            start = np.concatenate([[since], end + 1])[: len(end)]
            size = end - start
            closed = np.ones(len(end), bool)
            rest = int(end[-1]) + 1 if len(end) else since
            if final and base + n > rest:
                start, size, closed = np.append(start, rest), np.append(size, base + n - rest), np.append(closed, False)
            m = len(start)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, f)), pa.array(doc + np.arange(m)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(closed)], ["file_id", "document", "start", "n_tokens", "closed"])


def token_counts(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """file_id, document (0, 1, ... in the file), start, n_tokens without the separator, closed."""
    s = stitched(found(blocks, separator, width))
    return s.select("file_id", "n", "seps", "base", "document", "since", "final").mapInArrow(_documents, SPANS)


def flat_blocks(docs: DataFrame, file: str, separator: int, text: str = "text", key: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents written as flat files of 2-byte ids, one for each partition, cut into blocks.

    Rows are file_id (of the partition), block and tokens; where a document
    ends, the rows with null tokens give its number in the file as ``block``
    and its ``doc_id``.
    """
    from enclosa.llm.packing import Encoder

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        f, e = TaskContext.get().partitionId(), Encoder(file)
        end = np.asarray([separator], "<u2").tobytes()
        held, block, n = bytearray(), 0, 0

        def row(k, tokens, ids):
            m = len(k)
            return pa.RecordBatch.from_arrays([pa.array([f] * m, pa.int64()), pa.array(k, pa.int64()), pa.array(tokens, pa.binary()), pa.array(ids, pa.int64())], ["file_id", "block", "tokens", "doc_id"])

        for b in batches:
            ids = b.column(0).to_pylist()
            for t in b.column(1):
                own = np.frombuffer(e.encode(t.as_py() or ""), "<u4")
                if len(own) and own.max() >= 1 << 16:
                    raise ValueError(f"id {own.max()} does not fit in two bytes")
                held += own.astype("<u2").tobytes() + end
                while len(held) >= 2 * block_tokens:
                    yield row([block], [bytes(held[: 2 * block_tokens])], [None])
                    del held[: 2 * block_tokens]
                    block += 1
            yield row(list(range(n, n + len(ids))), [None] * len(ids), ids)
            n += len(ids)
        if held:
            yield row([block], [bytes(held)], [None])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(part, BLOCKS + ", doc_id long")
