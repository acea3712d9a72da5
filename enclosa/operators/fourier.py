"""Fourier series a0 + sum a_m sin(m t) + b_m cos(m t) as tables, their bases and quadrature.

A series is a table (mode, a, b); mode 0 carries a0 in b, and an absent mode is
0.  A general basis has index 0 for 1/2, 2n - 1 for sin(n t) and 2n for
cos(n t); a cosine basis has index n for cos(n t).
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from enclosa.types import InvalidArgumentError, Matrix, StateError

SCHEMA = "mode int, a double, b double"


# --- coefficient pairs: structs (a, b) -----------------------------------------


def pair(a: Column | float, b: Column | float) -> Column:
    """a sin + b cos."""
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for x, n in ((a, "a"), (b, "b"))])


def pair_add(x: Column, y: Column) -> Column:
    return pair(x["a"] + y["a"], x["b"] + y["b"])


def pair_sub(x: Column, y: Column) -> Column:
    return pair(x["a"] - y["a"], x["b"] - y["b"])


def pair_scale(x: Column, s: Column | float) -> Column:
    return pair(x["a"] * s, x["b"] * s)


def pair_divide(x: Column, s: Column | float) -> Column:
    return pair(x["a"] / s, x["b"] / s)


def pair_shift(x: Column, tau: Column) -> Column:
    """The pair with its argument increased by tau."""
    return pair(x["a"] * F.cos(tau) - x["b"] * F.sin(tau), x["b"] * F.cos(tau) + x["a"] * F.sin(tau))


# --- series ----------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Series:
    df: DataFrame
    order: int

    def like(self, df: DataFrame, order: int | None = None) -> Series:
        return Series(df.select("mode", "a", "b"), self.order if order is None else order)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def a0(self) -> float:
        return self._of(0, "b")

    def sin(self, m: int) -> float:
        return self._of(m, "a")

    def cos(self, m: int) -> float:
        return self._of(m, "b")

    def _of(self, m: int, c: str) -> float:
        r = self.df.where(F.col("mode") == m).agg(F.sum(c)).first()[0]
        return 0.0 if r is None else r

    def with_a0(self, x: float) -> Series:
        return self._with(0, 0.0, x)

    def with_sin(self, m: int, x: float) -> Series:
        return self._with(m, x, self.cos(m))

    def with_cos(self, m: int, x: float) -> Series:
        return self._with(m, self.sin(m), x)

    def _with(self, m: int, a: float, b: float) -> Series:
        if not 0 <= m <= self.order:
            raise InvalidArgumentError(f"mode {m} of a series of order {self.order}")
        one = self.spark.createDataFrame([(m, float(a), float(b))], SCHEMA)
        return self.like(self.df.where(F.col("mode") != m).unionByName(one))

    # --- arithmetic ---

    def __add__(self, other: Series | float) -> Series:
        return self._either(other, 1.0)

    __radd__ = __add__

    def __sub__(self, other: Series | float) -> Series:
        return self._either(other, -1.0)

    def __rsub__(self, other: float) -> Series:
        return (-self) + other

    def __pos__(self) -> Series:
        return self

    def __neg__(self) -> Series:
        return self * -1.0

    def _either(self, other: Series | float, sign: float) -> Series:
        if not isinstance(other, Series):
            return self.like(self.df.withColumn("b", F.when(F.col("mode") == 0, F.col("b") + sign * float(other)).otherwise(F.col("b"))))
        d = self.df.join(other.df.toDF("mode", "c", "d"), "mode", "full")
        zero = F.lit(0.0)
        return self.like(d.select("mode", (F.coalesce("a", zero) + sign * F.coalesce("c", zero)).alias("a"), (F.coalesce("b", zero) + sign * F.coalesce("d", zero)).alias("b")), max(self.order, other.order))

    def __mul__(self, other: Series | float) -> Series:
        """Of two series, by the product formulas: every pair of modes gives their sum and their difference."""
        if not isinstance(other, Series):
            return self.like(self.df.select("mode", (F.col("a") * float(other)).alias("a"), (F.col("b") * float(other)).alias("b")))
        d = self.df.toDF("m", "a", "b").join(other.df.toDF("n", "c", "d"), how="cross")  # (order + 1)^2 pairs are the operation itself
        a, b, c, e = (F.col(x) for x in "abcd")
        plain = (F.col("m") == 0) | (F.col("n") == 0)
        sign = F.when(F.col("m") >= F.col("n"), 1.0).otherwise(-1.0)
        total = F.struct((F.col("m") + F.col("n")).alias("mode"), F.when(plain, a * e + b * c).otherwise((a * e + b * c) / 2).alias("a"), F.when(plain, b * e).otherwise((b * e - a * c) / 2).alias("b"))
        apart = F.struct(F.abs(F.col("m") - F.col("n")).alias("mode"), (sign * (a * e - b * c) / 2).alias("a"), ((b * e + a * c) / 2).alias("b"))
        terms = F.explode(F.when(plain, F.array(total)).otherwise(F.array(total, apart))).alias("x")
        d = d.select(terms).select("x.*").groupBy("mode").agg(F.sum(F.when(F.col("mode") == 0, 0.0).otherwise(F.col("a"))).alias("a"), F.sum("b").alias("b"))
        return self.like(d, self.order + other.order)

    __rmul__ = __mul__

    def __truediv__(self, x: float) -> Series:
        return self.like(self.df.select("mode", (F.col("a") / float(x)).alias("a"), (F.col("b") / float(x)).alias("b")))

    def mul_sin(self, n: int) -> Series:
        return self._mul_one(n, 1.0, 0.0)

    def mul_cos(self, n: int) -> Series:
        return self._mul_one(n, 0.0, 1.0)

    def _mul_one(self, n: int, a: float, b: float) -> Series:
        if n <= 0:
            raise InvalidArgumentError(f"multiplication by mode {n}")
        return self * Series(self.spark.createDataFrame([(n, a, b)], SCHEMA), n)

    # --- calculus ---

    def delay(self, tau: float) -> Series:
        """The series at t + tau."""
        x = pair_shift(F.struct("a", "b"), F.col("mode") * F.lit(float(tau)))
        return self.like(self.df.withColumn("x", x).select("mode", "x.a", "x.b"))

    def diff(self) -> Series:
        return self.like(self.df.select("mode", (-F.col("mode") * F.col("b")).alias("a"), (F.col("mode") * F.col("a")).alias("b")))

    def projection(self, m: int) -> Series:
        return self.like(self.df.where(F.col("mode") <= m), min(m, self.order))

    def remainder(self, m: int) -> Series:
        return self.like(self.df.where(F.col("mode") > m))

    def value(self, t: float | Column) -> Column | DataFrame:
        t = F.lit(float(t)) if not isinstance(t, Column) else t
        return self.df.agg(F.sum(F.col("a") * F.sin(F.col("mode") * t) + F.col("b") * F.cos(F.col("mode") * t)).alias("v"))

    def sampled(self, t0: float, t1: float, tau: float) -> DataFrame:
        """(t, value) from t0 to t1 in steps of tau; as csv() it is the plotting file."""
        n = int(math.floor((t1 - t0) / tau + 1e-9)) + 1
        t = self.spark.range(n).select((F.lit(float(t0)) + F.col("id") * float(tau)).alias("t"))
        d = t.join(F.broadcast(self.df), how="cross")  # order + 1 rows beside each point
        return d.groupBy("t").agg(F.sum(F.col("a") * F.sin(F.col("mode") * F.col("t")) + F.col("b") * F.cos(F.col("mode") * F.col("t"))).alias("value"))

    def save_sampled(self, path: str, t0: float, t1: float, tau: float) -> None:
        self.sampled(t0, t1, tau).orderBy("t").write.csv(path)

    def norm_l2(self) -> DataFrame:
        s = F.when(F.col("mode") == 0, 2 * F.col("b") * F.col("b")).otherwise(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
        return self.df.agg(F.sqrt(F.coalesce(F.sum(s), F.lit(0.0))).alias("v"))

    def norm_inf(self, n: int) -> DataFrame:
        """A bound: the greatest of n + 1 grid values, and h^2 / 2 times the sum of j^2 |c_j|."""
        h = 2 * math.pi / n
        top = self.sampled(0.0, 2 * math.pi, h).agg(F.max(F.abs("value")).alias("top"))
        bend = self.df.agg(F.coalesce(F.sum(F.col("mode") * F.col("mode") * (F.abs("a") + F.abs("b"))), F.lit(0.0)).alias("bend"))
        return top.crossJoin(bend).select((F.col("top") + h * h / 2 * F.col("bend")).alias("v"))

    def display(self) -> DataFrame:
        term = F.when(F.col("mode") == 0, F.format_string("%s", F.col("b"))).otherwise(F.format_string("%s sin(%dt) + %s cos(%dt)", F.col("a"), F.col("mode"), F.col("b"), F.col("mode")))
        items = F.sort_array(F.collect_list(F.struct("mode", term.alias("s"))))
        return self.df.agg(items.alias("x")).select(F.array_join(F.col("x.s"), " + ").alias("line"))


def series(spark: SparkSession, a0: float = 0.0, terms: Sequence[tuple[float, float]] = ()) -> Series:
    """From a0 and (sin, cos) coefficients of modes 1, 2, ..."""
    rows = [(0, 0.0, float(a0)), *((m, float(a), float(b)) for m, (a, b) in enumerate(terms, 1))]
    return Series(spark.createDataFrame(rows, SCHEMA), len(terms))


def constant(spark: SparkSession, order: int, x: float) -> Series:
    d = spark.range(order + 1).select(F.col("id").cast("int").alias("mode"), F.when(F.col("id") == 0, 0.0).otherwise(float(x)).alias("a"), F.lit(float(x)).alias("b"))
    return Series(d, order)


def zeros(spark: SparkSession, order: int) -> Series:
    return constant(spark, order, 0.0)


def ones(spark: SparkSession, order: int) -> Series:
    return constant(spark, order, 1.0)


# --- the general basis -------------------------------------------------------------


def basis_list(order: int, kind: str = "full", omit: Sequence[int] = ()) -> list[int]:
    """Indices: ``full`` (0, sin and cos), ``odd`` (sin) or ``even`` (0 and cos), without those omitted."""
    every = {"full": range(2 * order + 1), "odd": range(1, 2 * order, 2), "even": range(0, 2 * order + 1, 2)}
    if kind not in every:
        raise InvalidArgumentError(f"list {kind}")
    gone = set(omit)
    return [k for k in every[kind] if k not in gone]


def omit_a0() -> int:
    return 0


def omit_sin(n: int) -> int:
    return 2 * n - 1


def omit_cos(n: int) -> int:
    return 2 * n


def _indexed(s: Series) -> DataFrame:
    """(i, v): coefficients of the general basis; index 0 stands for 1/2, so its coefficient is twice a0."""
    cells = F.explode(F.when(F.col("mode") == 0, F.array(F.struct(F.lit(0).alias("i"), (2 * F.col("b")).alias("v")))).otherwise(F.array(
        F.struct((2 * F.col("mode") - 1).alias("i"), F.col("a").alias("v")), F.struct((2 * F.col("mode")).alias("i"), F.col("b").alias("v"))))).alias("x")
    return s.df.select(cells).select("x.i", "x.v")


@dataclasses.dataclass
class Assembly:
    """Residual and Jacobian of an equation for a series, from contributions over the general basis."""

    spark: SparkSession
    order: int
    kind: str = "full"
    omit: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        self.list = basis_list(self.order, self.kind)
        self.clear()

    def clear(self) -> None:
        self._f: list[DataFrame] = []
        self._j: list[DataFrame] = []
        self._iota: list[DataFrame] = []

    def _columns(self) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in self.list], "j int")

    def _need_full(self) -> None:
        if self.kind != "full":
            raise StateError("derivatives and delays mix sines and cosines: they need the full list")

    def add_residual(self, s: Series) -> None:
        self._f.append(_indexed(s))

    def add_scalar(self, x: float, tau: float | None = None) -> None:
        """x times the unknown, at t + tau."""
        d = self._columns()
        if tau is None:
            self._j.append(d.select(F.col("j").alias("i"), "j", F.lit(float(x)).alias("v")))
            return
        self._need_full()
        n = F.expr("(j + 1) div 2")
        sine = F.col("j") % 2 == 1
        c, s = F.cos(n * float(tau)), F.sin(n * float(tau))
        at = lambda i, v: F.struct(i.cast("int").alias("i"), (v * float(x)).alias("v"))
        cells = F.when(F.col("j") == 0, F.array(at(F.col("j"), F.lit(1.0)))).otherwise(F.array(at(F.col("j"), c), F.when(sine, at(F.col("j") + 1, s)).otherwise(at(F.col("j") - 1, -s))))
        self._j.append(d.select("j", F.explode(cells).alias("x")).select("x.i", "j", "x.v"))

    def add_series(self, s: Series, tau: float | None = None) -> None:
        """s times the unknown, at t + tau: each column is the product of s with its basis function."""
        if tau is not None:
            self._need_full()
        n = F.expr("CAST((j + 1) div 2 AS INT)")
        base = self._columns().select("j", n.alias("n"), F.when(F.col("j") % 2 == 1, 1.0).otherwise(0.0).alias("c"), F.when(F.col("j") == 0, 0.5).when(F.col("j") % 2 == 0, 1.0).otherwise(0.0).alias("d"))
        if tau is not None:
            x = pair_shift(pair(F.col("c"), F.col("d")), F.col("n") * F.lit(float(tau)))
            base = base.withColumn("x", x).select("j", "n", F.col("x.a").alias("c"), F.col("x.b").alias("d"))
        d = s.df.toDF("m", "a", "b").join(base, how="cross")  # the Jacobian has these entries
        a, b, c, e = (F.col(k) for k in ("a", "b", "c", "d"))
        plain = (F.col("m") == 0) | (F.col("n") == 0)
        sign = F.when(F.col("m") >= F.col("n"), 1.0).otherwise(-1.0)
        total = F.struct((F.col("m") + F.col("n")).alias("mode"), F.when(plain, a * e + b * c).otherwise((a * e + b * c) / 2).alias("a"), F.when(plain, b * e).otherwise((b * e - a * c) / 2).alias("b"))
        apart = F.struct(F.abs(F.col("m") - F.col("n")).alias("mode"), (sign * (a * e - b * c) / 2).alias("a"), ((b * e + a * c) / 2).alias("b"))
        d = d.select("j", F.explode(F.when(plain, F.array(total)).otherwise(F.array(total, apart))).alias("x")).where(F.col("x.mode") <= self.order)
        cells = F.explode(F.when(F.col("x.mode") == 0, F.array(F.struct(F.lit(0).alias("i"), (2 * F.col("x.b")).alias("v")))).otherwise(F.array(
            F.struct((2 * F.col("x.mode") - 1).alias("i"), F.col("x.a").alias("v")), F.struct((2 * F.col("x.mode")).alias("i"), F.col("x.b").alias("v"))))).alias("y")
        self._j.append(d.select("j", cells).select("y.i", "j", "y.v"))

    def add_derivative(self, times: int = 1, x: float = 1.0) -> None:
        """x times the first or second derivative of the unknown."""
        n = F.expr("(j + 1) div 2").cast("double")
        d = self._columns().where("j > 0")
        if times == 2:
            self._j.append(d.select(F.col("j").alias("i"), "j", (-n * n * float(x)).alias("v")))
            return
        self._need_full()
        sine = F.col("j") % 2 == 1
        self._j.append(d.select(F.when(sine, F.col("j") + 1).otherwise(F.col("j") - 1).cast("int").alias("i"), "j", (F.when(sine, n).otherwise(-n) * float(x)).alias("v")))

    def add_iota(self, s: Series) -> None:
        """A column for a parameter; the k-th takes the place of the k-th omitted index."""
        k = len(self._iota)
        if k >= len(self.omit):
            raise StateError("more parameters than omitted indices")
        self._iota.append(_indexed(s).select("i", F.lit(self.omit[k]).alias("j"), "v"))

    def _rows(self) -> DataFrame:
        return self.spark.createDataFrame([(k, r) for r, k in enumerate(self.list)], "index int, r int")

    def residual(self) -> Matrix:
        d = self._f[0]
        for x in self._f[1:]:
            d = d.unionByName(x)
        d = self._rows().join(d.groupBy("i").agg(F.sum("v").alias("v")), F.col("index") == F.col("i"), "left")
        return Matrix(d.select(F.col("r").alias("i"), F.lit(0).alias("j"), F.coalesce("v", F.lit(0.0)).alias("v")), len(self.list), 1)

    def jacobian(self) -> Matrix:
        """Omitted columns are replaced by the parameters' columns."""
        parts = [x.select("i", "j", "v") for x in self._j]
        d = parts[0]
        for x in parts[1:]:
            d = d.unionByName(x)
        if self.omit:
            gone = self.spark.createDataFrame([(k,) for k in self.omit], "j int")
            d = d.join(F.broadcast(gone), "j", "left_anti").select("i", "j", "v")  # as many rows as parameters
            for x in self._iota:
                d = d.unionByName(x)
        d = d.groupBy("i", "j").agg(F.sum("v").alias("v"))
        full = self._rows().toDF("i", "r").join(self._rows().toDF("j", "c"), how="cross")  # the matrix itself
        d = full.join(d, ["i", "j"], "left").select(F.col("r").alias("i"), F.col("c").alias("j"), F.coalesce("v", F.lit(0.0)).alias("v"))
        return Matrix(d, len(self.list), len(self.list))

    def to_series(self, v: Matrix) -> tuple[Series, DataFrame]:
        """The series of a vector over the list, and the parameters (index, v) at the omitted places."""
        d = v.df.join(self._rows(), F.col("i") == F.col("r")).select("index", "v")
        gone = F.col("index").isin(list(self.omit)) if self.omit else F.lit(False)
        mode = F.expr("CAST((index + 1) div 2 AS INT)")
        s = d.where(~gone).select(mode.alias("mode"), F.when(F.col("index") % 2 == 1, F.col("v")).otherwise(0.0).alias("a"), F.when(F.col("index") == 0, F.col("v") / 2).when(F.col("index") % 2 == 0, F.col("v")).otherwise(0.0).alias("b"))
        s = s.groupBy("mode").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        return Series(s, self.order), d.where(gone)

    def to_vector(self, s: Series) -> Matrix:
        d = self._rows().join(_indexed(s).groupBy("i").agg(F.sum("v").alias("v")), F.col("index") == F.col("i"), "left")
        return Matrix(d.select(F.col("r").alias("i"), F.lit(0).alias("j"), F.coalesce("v", F.lit(0.0)).alias("v")), len(self.list), 1)


def reindexed(d: DataFrame, gone: Sequence[int], column: str = "j") -> DataFrame:
    """The rows without the indices in ``gone``, numbered anew from 0."""
    kept = d.where(~F.col(column).isin(list(gone))) if gone else d
    number = kept.select(column).distinct().withColumn("new", F.row_number().over(Window.orderBy(column)) - 1)  # one row an index
    return kept.join(F.broadcast(number), column).drop(column).withColumnRenamed("new", column)


# --- the cosine basis ----------------------------------------------------------------


@dataclasses.dataclass
class CosineBasis:
    """cos(n t) for n up to ``order``, for problems with Neumann conditions."""

    spark: SparkSession
    order: int

    def _diagonal(self, v: Column) -> Matrix:
        n = self.order + 1
        d = self.spark.range(n * n).select((F.col("id") % n).cast("int").alias("i"), F.expr(f"CAST(id div {n} AS INT)").alias("j"))
        return Matrix(d.select("i", "j", F.when(F.col("i") == F.col("j"), v).otherwise(0.0).alias("v")), n, n)

    def stiffness(self) -> Matrix:
        return self._diagonal(F.col("i").cast("double") * F.col("i"))

    def mass(self) -> Matrix:
        return self._diagonal(F.when(F.col("i") == 0, 0.5).otherwise(1.0))

    def load(self, s: Series) -> Matrix:
        rows = self.spark.range(self.order + 1).select(F.col("id").cast("int").alias("i"))
        d = rows.join(s.df.select(F.col("mode").alias("i"), "b"), "i", "left").groupBy("i").agg(F.coalesce(F.sum("b"), F.lit(0.0)).alias("v"))
        return Matrix(d.select("i", F.lit(0).alias("j"), "v"), self.order + 1, 1)

    def jacobian(self, s: Series) -> Matrix:
        """(s cos(j t), cos(i t)): column j holds half of s's mode i - j and i + j; column 0 the load of s / 2."""
        n = self.order + 1
        cols = self.spark.range(n).select(F.col("id").cast("int").alias("j"))
        d = s.df.select("mode", "b").join(cols, how="cross")  # the matrix has these entries
        plain = (F.col("mode") == 0) | (F.col("j") == 0)
        whole = F.array(F.struct((F.col("mode") + F.col("j")).alias("i"), F.when(F.col("j") == 0, F.col("b") / 2).otherwise(F.col("b")).alias("v")))
        two = F.array(F.struct((F.col("mode") + F.col("j")).alias("i"), (F.col("b") / 2).alias("v")), F.struct(F.abs(F.col("mode") - F.col("j")).alias("i"), (F.col("b") / 2).alias("v")))
        d = d.select("j", F.explode(F.when(plain, whole).otherwise(two)).alias("x")).select("x.i", "j", "x.v").where(F.col("i") < n)
        grid = self._diagonal(F.lit(0.0)).df.select("i", "j")
        d = grid.join(d.groupBy("i", "j").agg(F.sum("v").alias("v")), ["i", "j"], "left")
        return Matrix(d.select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), n, n)

    def to_series(self, v: Matrix) -> Series:
        return Series(v.df.select(F.col("i").alias("mode"), F.lit(0.0).alias("a"), F.col("v").alias("b")), self.order)


# --- quadrature ------------------------------------------------------------------------

NODES = 12000


def _phi(j: Column, t: Column) -> Column:
    n = F.floor((j + 1) / 2)
    return F.when(j == 0, 1.0).when(j % 2 == 1, F.sin(n * t)).otherwise(F.cos(n * t))


@dataclasses.dataclass
class Quadrature:
    """Coefficients and Jacobians of a function by the rectangle rule on ``nodes`` points."""

    spark: SparkSession
    order: int
    nodes: int = NODES

    def sampled(self, f: Callable[[Column], Column]) -> DataFrame:
        t = F.col("id") * F.lit(2 * math.pi / self.nodes)
        return self.spark.range(self.nodes).select(t.alias("t")).withColumn("f", f(F.col("t")))

    def vector(self, samples: DataFrame) -> Matrix:
        """Coefficients over the general basis; a table (t, f) may also come from data."""
        n = 2 * self.order + 1
        d = samples.select("t", "f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
        w = F.when(F.col("i") == 0, 1.0).otherwise(2.0) / self.nodes
        d = d.groupBy("i").agg(F.sum(F.col("f") * _phi(F.col("i"), F.col("t"))).alias("s")).select("i", F.lit(0).alias("j"), (F.col("s") * w).alias("v"))
        return Matrix(d, n, 1)

    def jacobian(self, samples: DataFrame, tau: float = 0.0) -> Matrix:
        """Symmetric without a delay, whose upper half is computed then; with one, column functions are taken at t + tau."""
        n = 2 * self.order + 1
        index = F.sequence(F.lit(0), F.lit(n - 1))
        d = samples.select("t", "f", F.explode(index).alias("i")).select("*", F.explode(index).alias("j"))
        if tau == 0:
            d = d.where("i <= j")
        s = F.sum(F.col("f") * _phi(F.col("i"), F.col("t")) * _phi(F.col("j"), F.col("t") + float(tau)))
        d = d.groupBy("i", "j").agg(s.alias("s"))
        zeros = F.when(F.col("i") == 0, 1).otherwise(0) + F.when(F.col("j") == 0, 1).otherwise(0)
        d = d.select("i", "j", (F.col("s") / self.nodes * F.when(zeros == 2, 0.5).when(zeros == 1, 1.0).otherwise(2.0)).alias("v"))
        if tau == 0:
            both = F.explode(F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j"))))
            d = d.select(both.alias("at"), "v").select("at.i", "at.j", "v")
        return Matrix(d, n, n)
