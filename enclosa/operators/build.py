"""Constructors, and the way from tables to matrices and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enclosa.types import SQL_TYPES, VALUES, InvalidArgumentError, Matrix, StateError


def _grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    if rows < 0 or cols < 0:
        raise InvalidArgumentError(f"a matrix of {rows} x {cols}")
    i, j = (F.col("id") % max(rows, 1)).cast("int"), F.expr(f"CAST(id div {max(rows, 1)} AS INT)")
    return spark.range(rows * cols).select(i.alias("i"), j.alias("j"))


def filled(spark: SparkSession, rows: int, cols: int | None, value: Column | dict[str, Column], elem: str = "double") -> Matrix:
    cols = 1 if cols is None else cols
    value = value if isinstance(value, dict) else dict.fromkeys(VALUES[elem], value)
    df = _grid(spark, rows, cols).select("i", "j", *[value[c].cast(SQL_TYPES[elem]).alias(c) for c in VALUES[elem]])
    return Matrix(df, rows, cols, elem)


def zeros(spark: SparkSession, rows: int, cols: int | None = None, elem: str = "double") -> Matrix:
    """rows x cols; with one size a column vector."""
    return filled(spark, rows, cols, F.array(F.lit(0.0)) if elem == "poly" else F.lit(False) if elem == "bool" else F.lit(0), elem)


def ones(spark: SparkSession, rows: int, cols: int | None = None, elem: str = "double") -> Matrix:
    one: Column | dict[str, Column] = F.array(F.lit(1.0)) if elem == "poly" else F.lit(True) if elem == "bool" else F.lit(1)
    if elem == "dd":
        one = {"hi": F.lit(1), "lo": F.lit(0)}
    if elem == "interval_dd":
        one = {"lo_hi": F.lit(1), "lo_lo": F.lit(0), "hi_hi": F.lit(1), "hi_lo": F.lit(0)}
    return filled(spark, rows, cols, one, elem)


def eye(spark: SparkSession, n: int, elem: str = "double") -> Matrix:
    one = F.when(F.col("i") == F.col("j"), 1).otherwise(0)
    return filled(spark, n, n, {c: F.lit(0) if c.endswith("lo") and elem in ("dd",) else one for c in VALUES[elem]}, elem)


def randn(spark: SparkSession, rows: int, cols: int | None = None, *, seed: int) -> Matrix:
    """N(0,1) elements; the seed is required, and an element depends on seed and place alone."""
    cols = 1 if cols is None else cols
    # Box-Muller over hashes: not on how rows lie in partitions, as a generator per task would be.
    u = [(F.abs(F.xxhash64(F.lit(seed), F.lit(k), "i", "j") % (1 << 52)) + 0.5) / float(1 << 52) for k in (0, 1)]
    return filled(spark, rows, cols, F.sqrt(-2 * F.ln(u[0])) * F.cos(u[1] * 6.283185307179586))


def all_true(spark: SparkSession, rows: int, cols: int | None = None) -> Matrix:
    return ones(spark, rows, cols, "bool")


def all_false(spark: SparkSession, rows: int, cols: int | None = None) -> Matrix:
    return zeros(spark, rows, cols, "bool")


def vector(spark: SparkSession, values: Sequence[float]) -> Matrix:
    """A column vector of these values."""
    rows = [(i, 0, float(x)) for i, x in enumerate(values)]
    return Matrix(spark.createDataFrame(rows, "i int, j int, v double"), len(rows), 1)


def init(target: Matrix, values: Sequence[float]) -> Matrix:
    """``target``, a vector, with its first elements set to these values and the others 0."""
    if target.kind == "M":
        raise StateError("init of a matrix that is not a vector")
    if len(values) > target.size:
        raise InvalidArgumentError(f"{len(values)} values for {target.size} elements")
    place = F.greatest("i", "j")
    known = F.array(*[F.lit(float(x)) for x in values]) if values else F.array().cast("array<double>")
    return target.like(target.df.withColumn("v", F.coalesce(F.get(known, place), F.lit(0.0))))


def init_vector(target: Matrix, values: Sequence[float]) -> Matrix:
    """As init, with the first value doubled: the constant term of a Fourier vector counts half."""
    return init(target, [2 * values[0], *values[1:]] if values else values)


def resize(a: Matrix, rows: int, cols: int) -> Matrix:
    """``a`` with rows and columns of zeros (false) added; it cannot shrink."""
    if rows < a.rows or cols < a.cols:
        raise InvalidArgumentError(f"resize from {a.rows} x {a.cols} to {rows} x {cols} would shrink")
    spark = a.df.sparkSession
    new = _grid(spark, rows, cols).where((F.col("i") >= a.rows) | (F.col("j") >= a.cols))
    zero = {c: (F.array(F.lit(0.0)) if a.elem == "poly" else F.lit(False) if a.elem == "bool" else F.lit(0)).cast(SQL_TYPES[a.elem]).alias(c) for c in a.values}
    if a.by:
        new = a.df.select(*a.by).distinct().join(new, how="cross")  # one small grid for each key
    return a.like(a.df.select(*a.keys, *a.values).unionByName(new.select(*a.keys, *zero.values())), rows, cols)


def from_table(df: DataFrame, row: str, columns: Sequence[str | Column], rows: int, by: Sequence[str] = ()) -> Matrix:
    """A matrix whose row ``row`` (an int from 0) has these columns as its elements."""
    cells = [F.struct(F.lit(k).alias("j"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for k, c in enumerate(columns)]
    d = df.select(*by, F.col(row).cast("int").alias("i"), F.explode(F.array(*cells)).alias("x"))
    return Matrix(d.select(*by, "i", "x.j", "x.v"), rows, len(columns), by=tuple(by))


def from_array(df: DataFrame, row: str, array: str, rows: int, cols: int, by: Sequence[str] = ()) -> Matrix:
    """A matrix whose row ``row`` is an array of numbers."""
    d = df.select(*by, F.col(row).cast("int").alias("i"), F.posexplode(array).alias("j", "v"))
    return Matrix(d.withColumn("v", F.col("v").cast("double")), rows, cols, by=tuple(by))


def to_table(a: Matrix, prefix: str = "c") -> DataFrame:
    """One row for each matrix row, with a column for each matrix column; for few columns."""
    if a.elem not in ("double", "int", "bool"):
        raise StateError("to_table needs one value column")
    return a.df.groupBy(*a.by, "i").agg(*[F.max(F.when(F.col("j") == k, F.col("v"))).alias(f"{prefix}{k}") for k in range(a.cols)])
