"""Language ID by error-correcting output codes.

Each language gets a codeword of BITS bits.  For each bit a logistic classifier
over hashed byte n-grams predicts whether the text's language has it; the
languages' losses, weighted by how well each bit did in training, are summed,
and the nearest codeword wins.  A small gap to the second codeword flags the
prediction as ambiguous.

Training looks at a bounded sample (``sample`` rows, the smallest hashes of
doc_id among the rows with a language, per language) of the folds that may be
learned from; prediction looks at every whole text and nothing else.

The sample's features are made on the executors and reach the driver as the
n-grams that occur: at most DIM numbers a row, however long the texts are.

A null text, or one without a letter, is ``und`` with score 0.  Where no row can
be learned from, every prediction is ``und``.  Rows that repeat a doc_id, and
rows without one, are predicted one by one; of rows that repeat a doc_id and a
language one text is learned from, and rows without doc_id are not.  An empty
table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from enclosa.llm.common import held_out
from enclosa.llm.rows import small
from enclosa.llm.textblocks import blocks

DIM = 1 << 12
BITS = 15
SAMPLE = 800
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, bit_distance int"
#: Bytes as the n-grams see them: A-Z as a-z, everything else in ASCII as one space.
_SEEN = np.arange(256, dtype=np.uint32)
_SEEN[:128] = 32
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text, the unit vector of square roots of hashed 1- to 3-gram counts (rows x DIM)."""
    n = len(off) - 1
    out = np.zeros((n, DIM), np.float32)
    x = _SEEN[data]
    for i in range(n):
        t = x[off[i] : off[i + 1]]
        if len(t):
            h2 = t[:-1] * np.uint32(0x9E3779B1) + t[1:] * np.uint32(0x85EBCA6B)
            h3 = h2[:-1] * np.uint32(0xC2B2AE35) + t[2:] * np.uint32(0x27D4EB2F)
            c = np.bincount(h3 >> np.uint32(20), minlength=DIM) + np.bincount(h2 >> np.uint32(20), minlength=DIM)
            c[:256] += np.bincount(t, minlength=256)
            v = np.sqrt(c.astype(np.float32))
            out[i] = v / np.linalg.norm(v)
    return out


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text, lang) with a letter in the text: the features that are not zero."""
    for b in batches:
        for lo, hi, data, off in blocks(b.column(1)):
            x = features(data, off)
            own = [k for k in range(hi - lo) if _LETTER.search(b.column(1)[lo + k].as_py())]
            at = [np.flatnonzero(x[k]) for k in own]
            some = b.slice(lo, hi - lo).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [some.column(0).cast(pa.int64()), some.column(2).cast(pa.string()), pa.array([p.astype("<u2").tobytes() for p in at], pa.binary()), pa.array([x[k, p].astype("<f4").tobytes() for k, p in zip(own, at, strict=True)], pa.binary())],
                ["id", "lang", "places", "counts"])


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1; the best of many random draws by least distance, each bit splitting the languages."""
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(400):
        c = rng.choice([-1, 1], (n, bits))
        if n > 1:
            c[:, np.abs(c.sum(0)) == n] *= np.where(np.arange(n) % 2, -1, 1)[:, None]
            d = (c[:, None] != c[None]).sum(2)
            d[np.diag_indices(n)] = bits
            if d.min() > far:
                best, far = c, d.min()
        else:
            return c
    return best


def train(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 100, rate: float = 20.0, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (DIM x bits), offsets and bit weights; logistic loss, languages weighted alike."""
    t = code[y].astype(np.float32)
    share = 1.0 / np.bincount(y, minlength=len(code))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -t * share / (1 + np.exp(np.clip(t * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw + x.T @ g + l2 * w, 0.9 * vb + g.sum(0)
        w, b = w - rate * vw, b - 0.1 * rate * vb
    right = ((x @ w + b) * t > 0).astype(np.float32)
    e = np.clip(1 - (right * share).sum(0), 1e-3, 0.499)
    alpha = np.log((1 - e) / e)
    return w, b, alpha / alpha.sum()


def decode(margins: np.ndarray, code: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, share of belief in it (0 to 1), and gap to the second, by weighted logistic loss."""
    loss = np.stack([np.log1p(np.exp(np.clip(-margins * c, -30, 30))) @ alpha for c in code], 1)
    best = loss.argmin(1)
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * code.shape[1] / 2)
    p /= p.sum(1, keepdims=True)
    s = np.sort(loss, 1)
    return best, p[np.arange(len(p)), best], s[:, 1] - s[:, 0] if len(code) > 1 else np.full(len(p), np.inf)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", sample: int = SAMPLE) -> dict | None:
    """The model, from at most ``sample`` texts of each label; None without labelled rows."""
    d = docs.select(F.col(key).alias("id"), F.col(label).alias("lang")).where(F.col("lang").isNotNull() & ~held_out("id"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    # Only ids with a small hash can be among the sample; the bound keeps the window small for a frequent label.
    total = d.groupBy("lang").agg(F.count("*").alias("c"))
    d = d.withColumn("h", F.xxhash64("id")).join(small(total), "lang").where(F.abs(F.col("h") / 2.0**63) <= 4 * sample / F.col("c"))
    chosen = d.withColumn("r", rank).where(F.col("r") <= sample).select("id", "lang").distinct()
    some = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "id").groupBy("id", "lang").agg(F.min("t").alias("t")).select("id", "t", "lang")
    rows = some.mapInArrow(_sparse, "id long, lang string, places binary, counts binary").toArrow().sort_by([("id", "ascending"), ("lang", "ascending"), ("counts", "ascending")])
    if not len(rows):
        return None
    named = rows.column("lang").to_pylist()
    langs = sorted(set(named))
    y = np.array([langs.index(x) for x in named])
    x = np.zeros((len(y), DIM), np.float32)
    for k, (at, v) in enumerate(zip(rows.column("places"), rows.column("counts"), strict=True)):
        x[k, np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(v.as_buffer(), "<f4")
    code = codewords(len(langs))
    w, b, alpha = train(x, y, code)
    return {"langs": langs, "code": code, "w": w, "b": b, "alpha": alpha}


def language_id(docs: DataFrame, model: dict | None, text: str = "text", key: str = "doc_id", least_gap: float = 0.02, extra: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, bit_distance for every row; with ``extra``, the text and these columns follow.

    ``ambiguous``: the losses of the two nearest codewords differ by less than
    ``least_gap``.  ``bit_distance``: bits in which the predicted signs differ
    from the codeword chosen.
    """
    model = model or {"langs": [], "code": np.zeros((0, 1)), "w": np.zeros((DIM, 1), np.float32), "b": np.zeros(1, np.float32), "alpha": np.ones(1)}
    cast = docs.sparkSession.sparkContext.broadcast(model)  # DIM x BITS floats: a fixed size

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        langs = np.array([*m["langs"], UND], dtype=object)
        for b in batches:
            t = b.column(2)
            for lo, hi, data, off in blocks(t):
                n = hi - lo
                pred, score, gap, apart = np.full(n, len(langs) - 1), np.zeros(n), np.zeros(n), np.zeros(n, np.int32)
                has = np.array([bool(x.as_py() and _LETTER.search(x.as_py())) for x in t.slice(lo, n)], bool)
                if len(m["langs"]) and has.any():
                    margins = features(data, off) @ m["w"] + m["b"]
                    best, p, g = decode(margins, m["code"], m["alpha"])
                    pred[has], score[has], gap[has] = best[has], p[has], g[has]
                    apart[has] = (np.sign(margins) != m["code"][best]).sum(1)[has]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n).cast(pa.int64()), b.column(1).slice(lo, n), pa.array(langs[pred], pa.string()), pa.array(score), pa.array(gap < least_gap), pa.array(apart), *(b.column(c).slice(lo, n) for c in (range(2, b.num_columns) if more else ()))],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "bit_distance", *more],
                )

    more = ["text", *extra] if extra is not None else []
    d = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"), *(extra or ()))
    return d.mapInArrow(part, ", ".join([SCHEMA, *(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in more)]))
