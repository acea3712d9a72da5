"""Quality by Bradley-Terry ranking of documents.

A document's score is linear in its features; for a preference pair (better,
worse), P(better wins) is the logistic function of the difference.  Pairs join
labelled documents of quality 1 and 0.  The decision threshold is a quantile of
the scores of all labelled documents that may be learned from, and the reported score is a logistic
rescaling under which that quantile is DECISION.

Only the weights come from a bounded sample of these documents (``sample`` of each
label, smallest hashes of doc_id); quantiles are read from a histogram of all
their scores.  The sample's features are made on the executors; the driver gets
their numbers, of the same size however long the texts are.  Scoring reads every
whole text and nothing else.

Empty and null texts have the features of an empty text.  Without labels of
both kinds every score is 0.5.  Duplicate labels of a document count once,
quality 0 before 1.  Rows that repeat a doc_id, and rows without one, are scored
one by one; of repeated ones the least text is learned from.  An empty table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enclosa.llm.common import held_out
from enclosa.llm.textblocks import NOT_SPACE, blocks, by_row, shingle_hashes, word_hashes, word_spans

SAMPLE = 6000
PAIRS = 20000
DECISION = 0.7
#: Bins of the histogram of scores, to a unit of score.
BINS = 1024
HASHED = 512
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, raw double"
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "line": (10,),
    "symbol": b"#*$%&|<>", "stop": b".!?", "comma": b",;:", "bang": b"!", "quote": b"\"'=@/\\{}[]()_", "high": range(128, 256),
}
_MARKS = np.stack([np.isin(np.arange(256), list(v)) for v in _CLASSES.values()], 1).astype(np.float32)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of byte classes, repetition of words, shingles and lines, lengths, and hashed words; rows x features."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    counts = np.zeros((n, 256))
    for i in range(n):
        counts[i] = np.bincount(data[off[i] : off[i + 1]], minlength=256)
    share = counts @ _MARKS / np.maximum(size, 1)[:, None]
    s, e, r = word_spans(data, off, NOT_SPACE)
    h = word_hashes(data, s, e)
    words = np.bincount(r, minlength=n).astype(np.float64)
    per = np.maximum(words, 1)

    def distinct(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
        o = by_row(v, rows)
        new = np.ones(len(o), bool)
        new[1:] = (v[o][1:] != v[o][:-1]) | (rows[o][1:] != rows[o][:-1])
        return np.bincount(rows[o][new], minlength=n)

    g, at = shingle_hashes(h, r, 3)
    ls, le, lr = word_spans(data, off, np.arange(256) != 10)
    lh = word_hashes(data, ls, le)
    lines = np.maximum(np.bincount(lr, minlength=n), 1)
    dense = np.column_stack([
        share, np.sqrt(share), np.log1p(words) / 10, np.minimum(words, 20) / 20, np.minimum(words, 100) / 100, size / per / 20,
        distinct(h, r) / per, distinct(g, r[at]) / np.maximum(np.bincount(r[at], minlength=n), 1), distinct(lh, lr) / lines, words / lines / 100,
    ])
    bag = np.zeros((n, HASHED), np.float32)
    np.add.at(bag, (r, (h >> np.uint64(64 - 9)).astype(np.int64)), 1)
    bag = np.sqrt(bag / per[:, None])
    return np.column_stack([dense, bag]).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text, q): id, q and the features."""
    for b in batches:
        for lo, hi, data, off in blocks(b.column(1)):
            own = [v.tobytes() for v in features(data, off).astype("<f4")]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), b.column(2).slice(lo, hi - lo).cast(pa.int64()), pa.array(own, pa.binary())], ["id", "q", "x"])


def train(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, steps: int = 400, rate: float = 0.5, l2: float = 1e-3, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights: logistic loss on the feature differences of preference pairs."""
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale < 1e-6, 1, scale)
    scale[-HASHED:] = max(1e-6, float(scale[-HASHED:].max()))
    rng = np.random.default_rng(seed)
    d = (good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]) / scale
    w, v = np.zeros(d.shape[1], np.float32), np.zeros(d.shape[1], np.float32)
    for _ in range(steps):
        g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / pairs + l2 * w
        v = 0.9 * v + g
        w = (w - rate * 0.1 * v).astype(np.float32)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> dict | None:
    """The model, its weights from at most ``sample`` documents of each label; None where a label is missing."""
    own = labels.select(F.col(key).alias("id"), F.col(label).alias("q")).where(F.col("q").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    own = own.groupBy("id").agg(F.min("q").alias("q"))
    chosen = None
    for q in (0, 1):
        some = own.where(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    some = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id").groupBy("id", "q").agg(F.min("t").alias("t")).select("id", "t", "q")
    rows = some.mapInArrow(_featured, "id long, q long, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    y = rows.column("q").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(v.as_buffer(), "<f4") for v in rows.column("x")])
    mean, scale, w = train(x[y == 1], x[y == 0])
    model = {"mean": mean, "scale": scale, "w": w}
    bins = histogram(docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & ~held_out("id")), own, model)
    edge, good, bad = (np.array([r[c] for r in bins], np.float64) for c in ("bin", "good", "bad"))
    edge, upto = edge / BINS, np.cumsum(good + bad)

    def quantile(p: np.ndarray | float) -> np.ndarray:
        """The bins of the quantiles."""
        return np.searchsorted(upto, np.asarray(p) * upto[-1])

    # The quantile that best parts the labels, each label counting alike.
    grid = quantile(np.linspace(0.01, 0.99, 197))
    fair = (good.sum() - (np.cumsum(good) - good)[grid]) / good.sum() + (np.cumsum(bad) - bad)[grid] / bad.sum()
    best = np.flatnonzero(fair >= fair.max() - 1e-9)
    spread = max(1e-6, float(edge[quantile(0.9)] - edge[quantile(0.1)]))
    return model | {"cut": float(edge[grid[best]].mean()), "slope": 6 / spread}


def raw_scores(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (((features(data, off) - model["mean"]) / model["scale"]) @ model["w"]).astype(np.float64)


def histogram(docs: DataFrame, labels: DataFrame, model: dict) -> list:
    """(bin, good, bad) in order of the bin: labelled rows of ``docs`` (id, t) by their scores, in bins of 1 / BINS."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in blocks(b.column(1)):
                at = np.floor(raw_scores(cast.value, data, off) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(at)], ["id", "bin"])

    scored = docs.select("id", "t").mapInArrow(part, "id long, bin long").join(labels, "id")
    return scored.groupBy("bin").agg(F.sum("q").alias("good"), F.sum(1 - F.col("q")).alias("bad")).orderBy("bin").collect()


def rank_quality(docs: DataFrame, model: dict | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, raw (the Bradley-Terry score) for every row of ``docs``."""
    cast = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    shift = float(np.log(DECISION / (1 - DECISION)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for b in batches:
            for lo, hi, data, off in blocks(b.column(2)):
                if m:
                    raw = raw_scores(m, data, off)
                    score = 1 / (1 + np.exp(np.clip(-(m["slope"] * (raw - m["cut"]) + shift), -700, 700)))
                else:
                    raw, score = np.zeros(hi - lo), np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).cast(pa.int64()), b.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= DECISION).astype(np.int32)), pa.array(raw)],
                    ["doc_id", "held_out", "score", "predicted", "raw"],
                )

    return docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text")).mapInArrow(part, SCHEMA)
