"""Enclosures: verified linear systems and eigenvalues.

Approximations come from the dense solvers; the certificates are interval
products, sums and norms of DataFrames, so nothing is certified by what is
being certified.  A query fails with a verification message where a certificate
does not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enclosa.functions import expr as X
from enclosa.operators.elementwise import convert, mapped, subtract, zipped
from enclosa.operators.product import matmul
from enclosa.operators.reduce import midpoint
from enclosa.operators.reshape import transpose
from enclosa.operators.solve import eigsym_vectors, eigsymge, inverse
from enclosa.types import DimensionError, Matrix


def _identity_removed(a: Matrix) -> Matrix:
    one = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    lo, hi = X.i_sub((F.col("lo"), F.col("hi")), (one, one))
    return a.like(a.df.select(*a.keys, lo.alias("lo"), hi.alias("hi")))


def _magnitudes(a: Matrix) -> DataFrame:
    return a.df.select(*a.keys, X.i_mag((F.col("lo"), F.col("hi"))).alias("_m"))


def upper_sum(items: Column) -> Column:
    """A bound of the sum of an array of non-negative numbers from above."""
    return F.aggregate(items, F.lit(0.0), lambda z, x: X.up(z + x))


def _line_sums(a: Matrix, line: str) -> DataFrame:
    return _magnitudes(a).groupBy(*a.by, line).agg(upper_sum(F.collect_list("_m")).alias("_s"))


def norm_bound(a: Matrix, line: str = "i") -> DataFrame:
    """by, _g: the greatest sum of magnitudes of a row ("i") or column ("j"), from above."""
    return _line_sums(a, line).groupBy(*a.by).agg(F.max("_s").alias("_g"))


def _with(d: DataFrame, other: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The one row of each key of ``other`` beside all rows of that key."""
    return d.join(other, list(by)) if by else d.crossJoin(F.broadcast(other))


def _below_one(g: Column, what: str) -> Column:
    return F.when(g < 1, g).otherwise(F.raise_error(F.concat(F.lit(f"verification: {what} is "), g.cast("string"), F.lit(", not below 1"))).cast("double"))


def verified_solve(a: Matrix, b: Matrix) -> Matrix:
    """Intervals that hold the solution of every system within the interval matrices a and b.

    With R near the inverse of the midpoints and x near the solution: the error
    is within |r| + |R a - I| ||r|| / (1 - ||R a - I||) for r = R (a x - b).
    """
    if a.rows != a.cols or a.rows != b.rows:
        raise DimensionError(f"a system of {a.rows} x {a.cols} with right-hand sides {b.rows} x {b.cols}")
    ma, mb = (midpoint(m) if m.elem == "interval" else m for m in (a, b))
    a, b = (m if m.elem == "interval" else convert(m, "interval") for m in (a, b))
    near = inverse(ma)
    x = matmul(near, mb)
    near, point = convert(near, "interval"), convert(x, "interval")
    rest = matmul(near, subtract(matmul(a, point), b))
    g = _identity_removed(matmul(near, a))
    rows = _line_sums(g, "i")
    whole = norm_bound(g).select(*a.by, _below_one(F.col("_g"), "the norm of R A - I").alias("_g"))
    size = _magnitudes(rest).groupBy(*a.by, "j").agg(F.max("_m").alias("_top"))
    d = _magnitudes(rest).join(size, [*a.by, "j"]).join(rows, [*a.by, "i"])
    d = _with(d, whole, a.by)
    bound = X.up(F.col("_m") + X.up(F.col("_s") * X.up(F.col("_top") / X.dn(1 - F.col("_g")))))
    d = d.select(*a.by, "i", "j", bound.alias("_e")).join(x.df, x.keys)
    return b.like(d.select(*b.keys, X.dn(F.col("v") - F.col("_e")).alias("lo"), X.up(F.col("v") + F.col("_e")).alias("hi")))


def _two_norm(a: Matrix, name: str) -> DataFrame:
    """by and a bound of the 2-norm: the root of the product of the other two."""
    d = norm_bound(a, "i").withColumnRenamed("_g", "_p")
    d = _with(d, norm_bound(a, "j").withColumnRenamed("_g", "_q"), a.by)
    return d.select(*a.by, X.up(F.sqrt(X.up(F.col("_p") * F.col("_q")))).alias(name))


def verified_eigsym(a: Matrix) -> Matrix:
    """A diagonal matrix of intervals that hold the eigenvalues of every symmetric matrix within a."""
    point = midpoint(a)
    point = zipped(point, transpose(point), lambda x, y: ((x[0] + y[0]) / 2,))
    values, vectors = eigsym_vectors(point)
    v = convert(vectors, "interval")
    rest = subtract(matmul(a, v), matmul(v, convert(values, "interval")))
    off = _identity_removed(matmul(transpose(v), v))
    d = _with(_two_norm(rest, "_p"), _two_norm(off, "_q"), a.by)
    d = d.select(*a.by, X.up(F.col("_p") / X.dn(1 - _below_one(F.col("_q"), "the norm of V'V - I"))).alias("_e"))
    d = _with(values.df, d, a.by)
    on = F.col("i") == F.col("j")
    return a.like(d.select(*a.keys, F.when(on, X.dn(F.col("v") - F.col("_e"))).otherwise(0.0).alias("lo"), F.when(on, X.up(F.col("v") + F.col("_e"))).otherwise(0.0).alias("hi")))


def merged(d: DataFrame, by: tuple[str, ...], key: str) -> DataFrame:
    """by, key, lo, hi: intervals that overlap are replaced by their hull."""
    before = Window.partitionBy(*by).orderBy("lo", key).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("new", F.when(F.col("lo") <= F.max("hi").over(before), 0).otherwise(1))
    d = d.withColumn("group", F.sum("new").over(Window.partitionBy(*by).orderBy("lo", key)))
    hull = Window.partitionBy(*by, "group")
    return d.select(*by, key, F.min("lo").over(hull).alias("lo"), F.max("hi").over(hull).alias("hi"))


def verified_eigsymge(a: Matrix, b: Matrix) -> Matrix:
    """A diagonal matrix of intervals that hold the eigenvalues of a x = lambda b x (Miyajima, 2012); overlapping ones are merged."""
    values, vectors = eigsymge(midpoint(a), midpoint(b))
    x = convert(vectors, "interval")
    bx = matmul(b, x)
    y = convert(inverse(midpoint(bx)), "interval")
    r = matmul(y, subtract(matmul(a, x), matmul(bx, convert(values, "interval"))))
    s = _identity_removed(matmul(y, bx))
    whole = _with(norm_bound(r).withColumnRenamed("_g", "_p"), norm_bound(s).withColumnRenamed("_g", "_q"), a.by)
    whole = whole.select(*a.by, X.up(F.col("_p") / X.dn(1 - _below_one(F.col("_q"), "the norm of Y B X - I"))).alias("_f"))
    d = _line_sums(r, "i").withColumnRenamed("_s", "_r").join(_line_sums(s, "i"), [*a.by, "i"])
    d = _with(d, whole, a.by).select(*a.by, "i", X.up(F.col("_r") + X.up(F.col("_f") * F.col("_s"))).alias("_e"))
    d = values.df.where("i = j").join(d, [*a.by, "i"])
    d = merged(d.select(*a.by, "i", X.dn(F.col("v") - F.col("_e")).alias("lo"), X.up(F.col("v") + F.col("_e")).alias("hi")), a.by, "i")
    full = values.df.select(*a.keys).join(d.withColumn("j", F.col("i")), a.keys, "left")
    return a.like(full.select(*a.keys, F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi")))


def inside(a: Matrix, b: Matrix) -> DataFrame:
    """One row (for each key): whether every interval of a lies in the interior of b's at its place."""
    d = zipped(a, b, lambda x, y: ((x[0] > y[0]) & (x[1] < y[1]),), "bool")
    v = F.bool_and("v").alias("v")
    return d.df.groupBy(*a.by).agg(v) if a.by else d.df.agg(v)


def krawczyk(near: Matrix, residual: Matrix, jacobian, start: Matrix, rounds: int = 20) -> Matrix:
    """A box of corrections that holds exactly one root: Z = -R F + (I - R DF(box)) box within the box.

    ``jacobian`` gives the interval derivative over a box of corrections; the
    box grows fourfold while the test fails.
    """
    from enclosa.operators.elementwise import negate
    from enclosa.plans.iterate import settled
    from enclosa.types import VerificationError

    r = convert(near, "interval")
    base = settled(negate(matmul(r, residual)))
    box = start
    for _ in range(rounds):
        slope = negate(_identity_removed(matmul(r, jacobian(box))))
        new = settled(zipped(base, matmul(slope, box), lambda x, y: X.i_add(x, y)))
        if inside(new, box).first()["v"]:
            return new
        box = mapped(box, lambda x: (x[0] * 4, x[1] * 4))
    raise VerificationError("no box of corrections maps into itself")
