"""Decompositions, linear systems and eigenproblems, one for each key.

A key's matrix is gathered into one task and solved there in numpy, which is
what scales for many small systems; its size is known before the plan is made,
and one beyond ``LARGEST`` elements is refused.  Small systems are one row each
and reach Python as Arrow batches of many; larger ones are a group each.  ``conjugate_gradient`` solves
one large positive definite system with joins alone.  The double-double forms
refine a double solution with residuals from error-free slice products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enclosa.functions import expr as X
from enclosa.operators import dense
from enclosa.operators.elementwise import add, convert, mapped, subtract, zipped
from enclosa.operators.product import matmul
from enclosa.operators.reduce import total
from enclosa.operators.reshape import transpose
from enclosa.plans.iterate import settled
from enclosa.types import DimensionError, InvalidArgumentError, Matrix, StateError

LARGEST = 2048 * 2048
#: Elements of the systems that are gathered into one row each.
ROW = 4096


def _cells(m: Matrix, tag: int) -> DataFrame:
    return m.df.select(*m.by, F.lit(tag).alias("tag"), "i", "j", F.col("v").alias("v"))


def grouped(some: list[Matrix], f: Callable[..., list[np.ndarray]], shapes: list[tuple[int, int]]) -> list[Matrix]:
    """``f`` of the matrices of each key; its results, of these shapes, as matrices that share one plan."""
    a = some[0]
    for m in some:
        if m.elem != "double":
            raise StateError(f"a dense solver on {m.elem} elements")
        if m.by != a.by:
            raise DimensionError(f"matrices for {a.by} and {m.by}")
        if m.size > LARGEST:
            raise InvalidArgumentError(f"{m.rows} x {m.cols} is too large for one task")
    cells = _cells(some[0], 0)
    for k, m in enumerate(some[1:], 1):
        cells = cells.unionByName(_cells(m, k))
    dims = [m.shape for m in some]
    by = list(a.by)
    types = {x.name: x.dataType.simpleString() for x in a.df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "tag int", "i int", "j int", "v double"])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        inputs = []
        tag, i, j, v = (frame[c].to_numpy() for c in ("tag", "i", "j", "v"))
        for k, d in enumerate(dims):
            x = np.zeros(d)
            at = tag == k
            x[i[at], j[at]] = v[at]
            inputs.append(x)
        out = []
        for k, z in enumerate(f(*inputs)):
            z = np.atleast_2d(z)
            p, q = np.indices(z.shape)
            out.append(pd.DataFrame({"tag": np.int32(k), "i": p.ravel().astype(np.int32), "j": q.ravel().astype(np.int32), "v": z.ravel().astype(float)}))
        z = pd.concat(out, ignore_index=True)
        for c in by:
            z[c] = frame[c].iloc[0]
        return z[[*by, "tag", "i", "j", "v"]]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(len(by))
            begin = items.offsets.to_numpy()
            flat = items.values
            tag, i, j, v = (flat.field(k).to_numpy() for k in range(4))
            size, out = [], []
            for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                inputs = [np.zeros(d) for d in dims]
                for k, x in enumerate(inputs):
                    at = lo + np.flatnonzero(tag[lo:hi] == k)
                    x[i[at], j[at]] = v[at]
                n = 0
                for k, z in enumerate(f(*inputs)):
                    z = np.atleast_2d(z)
                    p, q = np.indices(z.shape)
                    out.append((np.full(z.size, k, np.int32), p.ravel().astype(np.int32), q.ravel().astype(np.int32), z.ravel().astype(float)))
                    n += z.size
                size.append(n)
            if out:
                rows = pa.array(np.repeat(np.arange(len(size)), size))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(len(by))), *(pa.array(np.concatenate(c)) for c in zip(*out, strict=True))], [*by, "tag", "i", "j", "v"])

    if by and sum(m.size for m in some) <= ROW:
        d = cells.groupBy(*by).agg(F.collect_list(F.struct("tag", "i", "j", "v")).alias("items")).mapInArrow(many, schema)
    elif by:
        d = cells.groupBy(*by).applyInPandas(one, schema)
    else:
        d = cells.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(one, schema)
    return [Matrix(d.where(F.col("tag") == k).select(*by, "i", "j", "v"), *s, by=a.by) for k, s in enumerate(shapes)]


def lu(a: Matrix, band: int | None = None) -> tuple[Matrix, Matrix]:
    """Packed factors and the pivot order (a column of row numbers)."""
    n = a.rows
    return tuple(grouped([a], lambda x: [(r := dense.lu(x, band))[0], r[1][:, None].astype(float)], [(n, n), (n, 1)]))


def lu_factors(a: Matrix) -> tuple[Matrix, Matrix, Matrix]:
    """L with unit diagonal, U and the pivot order: the rows of a in that order are L U."""
    n = a.rows

    def f(x):
        packed, order = dense.lu(x)
        return [*dense.split(packed), order[:, None].astype(float)]

    return tuple(grouped([a], f, [(n, n), (n, n), (n, 1)]))


def trilu(a: Matrix) -> tuple[Matrix, Matrix]:
    """LU of a matrix with up to two bands beside its diagonal."""
    return lu(a, 2)


def substituted(packed: Matrix, order: Matrix, b: Matrix) -> Matrix:
    return grouped([packed, order, b], lambda p, o, x: [dense.substituted(p, o[:, 0].astype(int), x)], [b.shape])[0]


def _check_system(a: Matrix, b: Matrix) -> None:
    if a.rows != a.cols or a.rows != b.rows:
        raise DimensionError(f"a system of {a.rows} x {a.cols} with right-hand sides {b.rows} x {b.cols}")


def solve(a: Matrix, b: Matrix) -> Matrix:
    """x with a x = b, for any number of right-hand sides."""
    _check_system(a, b)
    if a.elem == "dd":
        return dd_solve(a, b)
    if a.elem == "interval":
        from enclosa.operators.verify import verified_solve

        return verified_solve(a, b)
    return grouped([a, b], lambda x, y: [dense.solve(x, y)], [b.shape])[0]


def inverse(a: Matrix) -> Matrix:
    if a.elem == "dd":
        from enclosa.operators.build import eye

        return dd_solve(a, eye(a.df.sparkSession, a.rows, "dd"))
    return grouped([a], lambda x: [dense.inverse(x)], [a.shape])[0]


def cholesky(a: Matrix) -> Matrix:
    return grouped([a], lambda x: [dense.cholesky(x)], [a.shape])[0]


def qr(a: Matrix, structure: str = "full") -> tuple[Matrix, Matrix]:
    return tuple(grouped([a], lambda x: list(dense.qr(x, structure)), [(a.rows, a.rows), a.shape]))


def qr_hessenberg(a: Matrix) -> tuple[Matrix, Matrix]:
    return qr(a, "hessenberg")


def qr_tridiagonal(a: Matrix) -> tuple[Matrix, Matrix]:
    return qr(a, "tridiagonal")


def tridiagonal(a: Matrix) -> tuple[Matrix, Matrix]:
    """T and the accumulated transform Q with a = Q T Q'."""
    return tuple(grouped([a], lambda x: list(dense.tridiagonal(x)), [a.shape, a.shape]))


def hessenberg(a: Matrix) -> tuple[Matrix, Matrix]:
    return tuple(grouped([a], lambda x: list(dense.hessenberg(x)), [a.shape, a.shape]))


def eigsym(a: Matrix) -> Matrix:
    """A diagonal matrix of the eigenvalues in rising order."""
    if a.elem == "interval":
        from enclosa.operators.verify import verified_eigsym

        return verified_eigsym(a)
    if a.elem == "dd":
        return dd_eigsym(a)[0]
    return grouped([a], lambda x: [np.diag(dense.eigen(x)[0])], [a.shape])[0]


def eigsym_vectors(a: Matrix) -> tuple[Matrix, Matrix]:
    if a.elem == "dd":
        return dd_eigsym(a)
    return tuple(grouped([a], lambda x: [np.diag((r := dense.eigen(x))[0]), r[1]], [a.shape, a.shape]))


def eigsymge(a: Matrix, b: Matrix) -> tuple[Matrix, Matrix]:
    """Eigenvalues (diagonal) and vectors of a x = lambda b x."""
    return tuple(grouped([a, b], lambda x, y: [np.diag((r := dense.eigen_general(x, y))[0]), r[1]], [a.shape, a.shape]))


# --- one large system --------------------------------------------------------


def conjugate_gradient(a: Matrix, b: Matrix, tolerance: float = 1e-10, steps: int = 1000) -> Matrix:
    """x with a x = b for a positive definite matrix that no task could hold: joins and sums for each step.

    Vectors are written to the shared folder at each step; two numbers come to
    the driver.
    """
    _check_system(a, b)
    x = b.like(b.df.withColumn("v", F.lit(0.0)))
    r = p = b
    rho = total(mapped(r, lambda v: (v[0] * v[0],)), "fast").element(0, 0)
    first = rho
    for _ in range(steps):
        if not rho > tolerance**2 * first:
            break
        q = settled(matmul(a, p, "fast"))
        alpha = rho / total(zipped(p, q, lambda s, t: (s[0] * t[0],)), "fast").element(0, 0)
        x = settled(zipped(x, p, lambda s, t: (s[0] + alpha * t[0],)))
        r = settled(zipped(r, q, lambda s, t: (s[0] - alpha * t[0],)))
        new = total(mapped(r, lambda v: (v[0] * v[0],)), "fast").element(0, 0)
        beta, rho = new / rho, new
        p = settled(zipped(r, p, lambda s, t: (s[0] + beta * t[0],)))
    return x


# --- double-double -----------------------------------------------------------


def _size(m: Matrix) -> float:
    r = m.df.agg(F.max(F.abs(F.col("hi"))).alias("m")).first()[0]
    return float(r or 0.0)


# Fixed values of the iterations' ends: a correction of this size relative to x
# is below double-double rounding, one that has not fallen to this share of the
# last no longer converges; and units of rounding of double-double numbers.
BELOW_ROUNDING, FALLING = 0.25e-32, 0.5
HYBRID_UNITS, DD_UNIT = 256, 2.0**-104


def dd_solve(a: Matrix, b: Matrix, steps: int = 10) -> Matrix:
    """Double solutions of exact residuals, added up until they are below BELOW_ROUNDING of x or stop falling."""
    _check_system(a, b)
    if a.by:
        raise StateError("the double-double solver takes one matrix")
    near = settled(inverse(mapped(a, lambda v: (v[0],), "double")))
    x = b.like(b.df.select(*b.keys, F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo")))
    r, before = b, float("inf")
    for _ in range(steps):
        d = settled(matmul(near, mapped(r, lambda v: (v[0],), "double")))
        x = settled(add(x, convert(d, "dd")))
        size, own = float(d.df.agg(F.max(F.abs("v"))).first()[0] or 0.0), _size(x)
        if size == 0 or size <= BELOW_ROUNDING * own or size >= FALLING * before:
            break
        before = size
        r = settled(subtract(b, matmul(a, x)))
    return x


def hybrid_solve(a: Matrix, b: Matrix, steps: int = 50) -> Matrix:
    """A double inverse as preconditioner and double-double residuals, until their solution is within HYBRID_UNITS of x."""
    _check_system(a, b)
    near = settled(convert(inverse(mapped(a, lambda v: (v[0],), "double")), "dd"))
    x = settled(matmul(near, b))
    for _ in range(steps):
        d = settled(matmul(near, subtract(matmul(a, x), b)))
        x = settled(subtract(x, d))
        size = d.df.where("j = 0").agg(F.max(F.abs("hi"))).first()[0]
        if not size or size <= HYBRID_UNITS * DD_UNIT * x.df.where("j = 0").agg(F.max(F.abs("hi"))).first()[0]:
            break
    return x


def refine_step(a: Matrix, x: Matrix) -> tuple[Matrix, Matrix]:
    """One Ogita-Aishima step: better eigenvectors, and the eigenvalues of these before it (a column)."""
    n = a.rows
    s = settled(matmul(transpose(x), matmul(a, x)))
    g = settled(matmul(transpose(x), x))
    pair = s.df.toDF("i", "j", "s_hi", "s_lo").join(g.df.toDF("i", "j", "g_hi", "g_lo"), ["i", "j"])
    diag = pair.where("i = j").withColumn("z", X.dd_div((F.col("s_hi"), F.col("s_lo")), (F.col("g_hi"), F.col("g_lo")))).select("i", "z.hi", "z.lo")
    values = settled(Matrix(diag.withColumn("j", F.lit(0)).select("i", "j", "hi", "lo"), n, 1, "dd"))
    # Sizes that decide which pairs are clustered: a few sums over the two matrices.
    rows = pair.groupBy("i").agg(F.sum(F.when(F.col("i") != F.col("j"), F.abs("s_hi")).otherwise(0.0)).alias("off"), F.sum(F.abs(F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - F.col("g_hi"))).alias("rest"))
    off, rest = rows.agg(F.max("off"), F.max("rest")).first()
    delta = 2 * (off + rest * values.df.agg(F.max(F.abs("hi"))).first()[0])
    lam = values.df.select("i", "hi", "lo")
    d = pair.join(lam.toDF("i", "a_hi", "a_lo"), "i").join(lam.toDF("j", "b_hi", "b_lo"), "j")
    one = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    d = d.withColumn("r", X.dd_add((one, F.lit(0.0)), (-F.col("g_hi"), -F.col("g_lo")))).withColumn("gap", X.dd_add((F.col("b_hi"), F.col("b_lo")), (-F.col("a_hi"), -F.col("a_lo"))))
    d = d.withColumn("t", X.dd_mul((F.col("b_hi"), F.col("b_lo")), (F.col("r.hi"), F.col("r.lo")))).withColumn("t", X.dd_add((F.col("s_hi"), F.col("s_lo")), (F.col("t.hi"), F.col("t.lo"))))
    apart = (F.col("i") != F.col("j")) & (F.abs("gap.hi") > delta)
    d = d.withColumn("e", F.when(apart, X.dd_div((F.col("t.hi"), F.col("t.lo")), (F.col("gap.hi"), F.col("gap.lo")))).otherwise(F.struct((F.col("r.hi") / 2).alias("hi"), (F.col("r.lo") / 2).alias("lo"))))
    e = settled(Matrix(d.select("i", "j", "e.hi", "e.lo"), n, n, "dd"))
    return settled(add(x, matmul(x, e))), values


def dd_eigsym(a: Matrix, steps: int = 2) -> tuple[Matrix, Matrix]:
    """Eigenvalues (diagonal) and vectors of a symmetric double-double matrix: double ones, refined at least twice."""
    _, v = eigsym_vectors(mapped(a, lambda x: (x[0],), "double"))
    v = settled(convert(v, "dd"))
    for _ in range(max(2, steps)):
        v, _ = refine_step(a, v)
    _, e = refine_step(a, v)
    from enclosa.operators.reshape import diag

    return diag(e), v


def dd_cholesky(a: Matrix) -> Matrix:
    """Upper factor of a double-double matrix: the double one, corrected twice."""
    u = settled(convert(cholesky(mapped(a, lambda x: (x[0],), "double")), "dd"))
    for _ in range(2):
        w = settled(convert(inverse(mapped(u, lambda x: (x[0],), "double")), "dd"))
        e = subtract(a, matmul(transpose(u), u))
        g = settled(matmul(transpose(w), matmul(e, w)))
        part = F.when(F.col("i") < F.col("j"), 1.0).when(F.col("i") == F.col("j"), 0.5).otherwise(0.0)
        half = g.like(g.df.select("i", "j", (F.col("hi") * part).alias("hi"), (F.col("lo") * part).alias("lo")))
        u = settled(add(u, matmul(half, u)))
    from enclosa.operators.reshape import triu

    return triu(u)


def truncated(a: Matrix) -> Matrix:
    """The leading doubles of a double-double matrix."""
    return mapped(a, lambda x: (x[0],), "double")
