"""Sub-matrices, triangles, diagonals, transposes, concatenation and symmetry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enclosa.types import DimensionError, IndexRangeError, InvalidArgumentError, Matrix


def _axis(selector: Sequence[int], size: int) -> tuple[int, int, int]:
    """First, step and last index of a selector: () all, (k,) one, (a, b) from a to b, (a, step, b) strided; ends count."""
    if len(selector) > 3:
        raise InvalidArgumentError(f"a selector of {len(selector)} numbers")
    a, step, b = {0: (0, 1, size - 1), 1: (*selector, 1, *selector), 2: (*selector[:1], 1, *selector[1:]), 3: tuple(selector)}[len(selector)]
    if a < 0 or b >= size or a > b or step < 1:
        raise IndexRangeError(f"selector {tuple(selector)} on an axis of {size}")
    return a, step, b


def submatrix(m: Matrix, rows: Sequence[int] = (), cols: Sequence[int] = ()) -> Matrix:
    df = m.df
    shape = []
    for c, selector, size in (("i", rows, m.rows), ("j", cols, m.cols)):
        a, step, b = _axis(selector, size)
        df = df.where(F.col(c).between(a, b) & ((F.col(c) - a) % step == 0)).withColumn(c, F.expr(f"CAST(({c} - {a}) div {step} AS INT)"))
        shape.append((b - a) // step + 1)
    return m.like(df, *shape)


def _kept(m: Matrix, keep) -> Matrix:
    zero = {"poly": F.array(F.lit(0.0)), "bool": F.lit(False), "int": F.lit(0)}.get(m.elem, F.lit(0.0))
    return m.like(m.df.select(*m.keys, *[F.when(keep, F.col(c)).otherwise(zero).alias(c) for c in m.values]))


def tril(m: Matrix) -> Matrix:
    return _kept(m, F.col("i") >= F.col("j"))


def triu(m: Matrix) -> Matrix:
    return _kept(m, F.col("i") <= F.col("j"))


def diag(m: Matrix) -> Matrix:
    """Of a vector the diagonal matrix, of a matrix its main diagonal as a column."""
    if m.kind in "RC":
        n = m.length
        own = m.df.withColumn("k", F.greatest("i", "j"))
        cells = own.select(*m.by, F.col("k").alias("i"), *m.values, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
        return _kept(m.like(cells, n, n), F.col("i") == F.col("j"))
    n = min(m.rows, m.cols)
    return m.like(m.df.where("i = j").withColumn("j", F.lit(0)), n, 1)


def transpose(m: Matrix) -> Matrix:
    return m.like(m.df.select(*m.by, F.col("j").alias("i"), F.col("i").alias("j"), *m.values), m.cols, m.rows)


def horzcat(*some: Matrix) -> Matrix:
    """Side by side; all have the same number of rows."""

    def two(a: Matrix, b: Matrix) -> Matrix:
        if a.rows != b.rows or a.elem != b.elem or a.by != b.by:
            raise DimensionError(f"horzcat of {a.rows} x {a.cols} {a.elem} and {b.rows} x {b.cols} {b.elem}")
        return a.like(a.df.select(*a.keys, *a.values).unionByName(b.df.withColumn("j", F.col("j") + a.cols).select(*a.keys, *a.values)), cols=a.cols + b.cols)

    return reduce(two, some)


def vercat(*some: Matrix) -> Matrix:
    """One above the other; all have the same number of columns."""

    def two(a: Matrix, b: Matrix) -> Matrix:
        if a.cols != b.cols or a.elem != b.elem or a.by != b.by:
            raise DimensionError(f"vercat of {a.rows} x {a.cols} {a.elem} and {b.rows} x {b.cols} {b.elem}")
        return a.like(a.df.select(*a.keys, *a.values).unionByName(b.df.withColumn("i", F.col("i") + a.rows).select(*a.keys, *a.values)), rows=a.rows + b.rows)

    return reduce(two, some)


def is_symmetric(m: Matrix) -> DataFrame:
    """One row (for each key): whether every element equals its mirror image exactly."""
    if m.rows != m.cols:
        d = m.df.select(*m.by).distinct() if m.by else m.df.sparkSession.range(1).select()
        return d.withColumn("v", F.lit(False))
    other = m.df.select(*m.by, F.col("j").alias("i"), F.col("i").alias("j"), *[F.col(c).alias(c + "_t") for c in m.values])
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(c + "_t") for c in m.values])
    d = m.df.join(other, m.keys)
    v = F.coalesce(F.bool_and(same), F.lit(True)).alias("v")
    return d.groupBy(*m.by).agg(v) if m.by else d.agg(v)
