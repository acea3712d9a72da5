"""Sums, extremes and norms; magnitudes, midpoints and radii of intervals.

A vector gives a scalar; a matrix gives a row of its columns' results.
``mode="exact"`` adds in order of the indices, which is the same for any
partitioning and gathers the terms of a result; ``mode="fast"`` uses plain sums with
partial aggregation.  The default, ``auto``, is exact up to ORDERED terms, known
from the shape, and fast beyond, so that no row ever holds more.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enclosa.functions import expr as X
from enclosa.operators.elementwise import mapped, zipped
from enclosa.operators.reshape import transpose
from enclosa.types import DimensionError, InvalidArgumentError, Matrix, StateError


#: Terms of one sum that are added in order by default; 1.5 MB of them at most.
ORDERED = 1 << 16


def summing(mode: str, terms: int) -> str:
    """``auto`` as exact or fast, by the number of terms."""
    return mode if mode != "auto" else "exact" if terms <= ORDERED else "fast"


def folded(df: DataFrame, groups: list[str], order: list[str], values: dict[str, Column], elem: str, mode: str) -> DataFrame:
    """``groups`` and the sum of the values, as columns of the same names."""
    names = list(values)
    if mode == "fast":
        if elem in ("double", "int"):
            return df.groupBy(*groups).agg(*[F.sum(v).alias(n) for n, v in values.items()])
        if elem == "interval":
            # Sums of n numbers in any order: off by n units of rounding of the sum of magnitudes.
            d = df.select(*groups, values["lo"].alias("lo"), values["hi"].alias("hi"))
            d = d.groupBy(*groups).agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.sum(F.greatest(F.abs("lo"), F.abs("hi"))).alias("m"), F.count("*").alias("n"))
            slack = F.col("n") * F.lit(2 * X.PHI) * F.col("m") + F.col("n") * F.lit(X.ETA)
            return d.select(*groups, X.dn(F.col("lo") - slack).alias("lo"), X.up(F.col("hi") + slack).alias("hi"))
        if elem == "dd" and order:
            # Ranges of the indices first (one of a vector's two is 0), so that no row holds all terms.
            part = F.expr(f"({' + '.join(order)}) div {ORDERED}").alias("part_")
            d = df.select(*groups, part, *[F.col(o).alias(f"o{k}_") for k, o in enumerate(order)], *[v.alias(n) for n, v in values.items()])
            d = folded(d, [*groups, "part_"], [f"o{k}_" for k in range(len(order))], {n: F.col(n) for n in names}, elem, "exact")
            return folded(d, groups, ["part_"], {n: F.col(n) for n in names}, elem, "exact")
    elif mode != "exact":
        raise InvalidArgumentError(f"mode {mode}")
    item = F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], *[v.alias(n) for n, v in values.items()])
    d = df.groupBy(*groups).agg(F.sort_array(F.collect_list(item)).alias("items"))
    if elem == "dd":
        return d.withColumn("z", X.dd_sum(F.col("items"))).select(*groups, "z.hi", "z.lo")
    if elem == "interval":
        z = F.aggregate("items", F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")), lambda z, x: F.struct(X.dn(z["lo"] + x["lo"]).alias("lo"), X.up(z["hi"] + x["hi"]).alias("hi")))
        return d.withColumn("z", z).select(*groups, "z.lo", "z.hi")
    if elem == "poly":
        return d.withColumn("c", F.aggregate("items", F.array(F.lit(0.0)), lambda z, x: X.poly_add(z, x["c"]))).select(*groups, "c")
    zero = F.lit(0).cast("int") if elem == "int" else F.lit(0.0)
    return d.select(*groups, F.aggregate("items", zero, lambda z, x: z + x[names[0]]).alias(names[0]))


def exact_totals(df: DataFrame, values: dict[str, tuple[Column, ...]]) -> DataFrame:
    """One row: for each name the sum of all its columns' numbers in double-double arithmetic, as a struct (hi, lo), the same for any partitioning; null without numbers.

    What numbers have above three powers of two, fixed by the greatest magnitude and
    the number of rows, is summed without rounding; plain sums are of what is left,
    below 2**-90 of the greatest for four million rows.  Two passes, and nothing is gathered.
    """
    flat = {f"{n}_{k}": c for n, some in values.items() for k, c in enumerate(some)}
    d = df.select(*[c.alias(n) for n, c in flat.items()])
    top = d.agg(F.count("*").alias("rows_"), *[F.max(F.abs(F.col(n))).alias(n) for n in flat]).first()
    wide = math.ceil(math.log2(top["rows_"] + 2))

    def parts(n: str) -> list[Column]:
        v, least = F.col(n), math.frexp(top[n] or 0.0)[1]
        if not math.isfinite(top[n] or 0.0) or least + wide > 1023:
            return [F.sum(v)]
        out = []
        for _ in range(3):
            sigma = F.lit(math.ldexp(1.0, least + wide))
            q = (v + sigma) - sigma
            out.append(F.sum(q))
            v, least = v - q, least + wide - 53
        return [*out, F.sum(v)]

    sums = {n: parts(n) for n in flat}
    d = d.agg(*[c.alias(f"{n}_{p}") for n, some in sums.items() for p, c in enumerate(some)])
    items = lambda n: F.array(*[F.struct(F.col(f"{n}_{k}_{p}").alias("hi"), F.lit(0.0).alias("lo")) for k in range(len(values[n])) for p in range(len(sums[f"{n}_{k}"]))])
    return d.select(*[F.when(F.col(f"{n}_0_0").isNotNull(), X.dd_sum(items(n))).alias(n) for n in values])


def _lines(a: Matrix) -> tuple[list[str], list[str], int]:
    """Group and order columns, and columns of the result: a matrix by column, a vector as a whole."""
    return ([*a.by, "j"], ["i"], a.cols) if a.kind == "M" else ([*a.by], ["i", "j"], 1)


def _row(a: Matrix, d: DataFrame, cols: int, elem: str | None = None) -> Matrix:
    if a.kind != "M":
        d = d.withColumn("j", F.lit(0))
    return a.like(d.withColumn("i", F.lit(0)), 1, cols, elem)


def total(a: Matrix, mode: str = "auto") -> Matrix:
    """Sum of a vector; of a matrix, sums of its columns."""
    groups, order, cols = _lines(a)
    mode = summing(mode, a.rows if a.kind == "M" else a.size)
    return _row(a, folded(a.df, groups, order, {c: F.col(c) for c in a.values}, a.elem, mode), cols)


def _extreme(a: Matrix, f) -> Matrix:
    groups, _, cols = _lines(a)
    if a.elem in ("double", "int"):
        d = a.df.groupBy(*groups).agg(f("v").alias("v"))
    elif a.elem == "interval":
        d = a.df.groupBy(*groups).agg(f("lo").alias("lo"), f("hi").alias("hi"))
    elif a.elem == "dd":
        d = a.df.groupBy(*groups).agg(f(F.struct("hi", "lo")).alias("z")).select(*groups, "z.hi", "z.lo")
    else:
        raise StateError(f"extremes of {a.elem} elements")
    return _row(a, d, cols)


def maximum(a: Matrix) -> Matrix:
    """NaN is the greatest number."""
    return _extreme(a, F.max)


def minimum(a: Matrix) -> Matrix:
    return _extreme(a, F.min)


def _absolute(a: Matrix) -> dict[str, Column]:
    if a.elem == "interval":
        return dict(zip(("lo", "hi"), X.i_abs((F.col("lo"), F.col("hi"))), strict=True))
    if a.elem != "double":
        raise StateError(f"norms of {a.elem} elements")
    return {"v": F.abs("v")}


def _scalar(a: Matrix, d: DataFrame) -> Matrix:
    return a.like(d.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)), 1, 1)


def _greatest_line(a: Matrix, line: str, other: str, mode: str) -> Matrix:
    d = folded(a.df, [*a.by, line], [other], _absolute(a), a.elem, summing(mode, a.rows if line == "j" else a.cols))
    return _scalar(a, d.groupBy(*a.by).agg(*[F.max(c).alias(c) for c in a.values]))


def norm_one(a: Matrix, mode: str = "auto") -> Matrix:
    """Sum of magnitudes of a vector; greatest column sum of a matrix."""
    if a.kind != "M":
        return _scalar(a, folded(a.df, [*a.by], ["i", "j"], _absolute(a), a.elem, summing(mode, a.size)))
    return _greatest_line(a, "j", "i", mode)


def norm_inf(a: Matrix, mode: str = "auto") -> Matrix:
    """Greatest magnitude of a vector; greatest row sum of a matrix."""
    if a.kind != "M":
        m = a.df.select(*a.by, *[v.alias(n) for n, v in _absolute(a).items()])
        return _scalar(a, m.groupBy(*a.by).agg(*[F.max(c).alias(c) for c in a.values]))
    return _greatest_line(a, "i", "j", mode)


def norm_two(a: Matrix, mode: str = "auto") -> Matrix:
    """Euclidean norm of a vector; of a matrix the root of the greatest eigenvalue of its Gram matrix, from 0 on."""
    if a.kind != "M":
        square = {"v": F.col("v") * F.col("v")} if a.elem == "double" else dict(zip(("lo", "hi"), X.i_pow((F.col("lo"), F.col("hi")), 2), strict=True))
        d = folded(a.df, [*a.by], ["i", "j"], square, a.elem, summing(mode, a.size))
        root = {"v": F.sqrt("v")} if a.elem == "double" else dict(zip(("lo", "hi"), X.i_sqrt((F.greatest(F.col("lo"), F.lit(0.0)), F.col("hi"))), strict=True))
        return _scalar(a, d.select(*a.by, *[v.alias(n) for n, v in root.items()]))
    from enclosa.operators.product import gram
    from enclosa.operators.solve import eigsym

    values = eigsym(gram(a if a.rows >= a.cols else transpose(a), mode))
    d = values.df.where("i = j").groupBy(*a.by).agg(F.sqrt(F.greatest(F.lit(0.0), F.max("v"))).alias("v"))
    return _scalar(dataclasses.replace(a, elem="double"), d)


# --- intervals ---------------------------------------------------------------


def _need_interval(a: Matrix) -> None:
    if a.elem != "interval":
        raise StateError(f"an interval operator on {a.elem} elements")


def _part(f, elem: str):
    def g(a: Matrix) -> Matrix:
        _need_interval(a)
        return mapped(a, lambda x: f(x), elem)

    return g


magnitude = _part(lambda x: (X.i_mag(x),), "double")
interval_magnitude = _part(lambda x: (X.i_mag(x), X.i_mag(x)), "interval")
zero_ball = _part(lambda x: (-X.i_mag(x), X.i_mag(x)), "interval")
midpoint = _part(lambda x: (X.i_mid(x),), "double")
interval_midpoint = _part(lambda x: (X.i_mid(x), X.i_mid(x)), "interval")
radius = _part(lambda x: (X.i_rad(x),), "double")


def mid_rad(a: Matrix) -> tuple[Matrix, Matrix]:
    return midpoint(a), radius(a)


def interval(a: Matrix) -> Matrix:
    """Degenerate intervals of a point matrix."""
    return mapped(a, lambda x: (x[0], x[0]), "interval")


def symmetrised(a: Matrix) -> Matrix:
    """Each element intersected with its mirror image; the query fails where these are disjoint."""
    _need_interval(a)
    if a.rows != a.cols:
        raise DimensionError(f"symmetrised needs a square matrix: {a.rows} x {a.cols}")

    def body(x, y):
        lo, hi = F.greatest(x[0], y[0]), F.least(x[1], y[1])
        return F.when(lo > hi, F.raise_error(F.lit("verification: an element and its mirror image are disjoint")).cast("double")).otherwise(lo), hi

    return zipped(a, transpose(a), body)


def add_point(a: Matrix, b: Matrix) -> Matrix:
    """An interval matrix plus a point matrix."""
    _need_interval(a)
    return zipped(a, interval(b), lambda x, y: X.i_add(x, y))
