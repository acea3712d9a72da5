"""Gauss-Legendre quadrature, the Legendre basis on (0, 1)^d and its functionals.

Coefficients are exact rationals on the driver and nodes are enclosed there by
sign changes at rational points; what depends on the number of nodes, basis
functions or boxes is a DataFrame.
"""

from __future__ import annotations

import dataclasses
import math
from fractions import Fraction
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enclosa.functions import expr as X
from enclosa.types import DimensionError, DomainError, InvalidArgumentError, Matrix, StateError, VerificationError

Poly = list[Fraction]
BITS = 200


def value(p: Poly, x):
    out = 0 * x
    for c in reversed(p):
        out = out * x + c
    return out


def derivative(p: Poly) -> Poly:
    return [c * k for k, c in enumerate(p)][1:] or [Fraction(0)]


def integral(p: Poly) -> Poly:
    return [Fraction(0), *(c / (k + 1) for k, c in enumerate(p))]


def product(p: Poly, q: Poly) -> Poly:
    out = [Fraction(0)] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] += a * b
    return out


@cache
def _legendre(n: int, shifted: bool) -> tuple[Fraction, ...]:
    x = [Fraction(-1), Fraction(2)] if shifted else [Fraction(0), Fraction(1)]
    if n < 2:
        return tuple([Fraction(1)] if n == 0 else x)
    a, b = product(x, list(_legendre(n - 1, shifted))), [*_legendre(n - 2, shifted), Fraction(0), Fraction(0)]
    return tuple(((2 * n - 1) * s - (n - 1) * t) / n for s, t in zip(a, b, strict=True))


def legendre(n: int) -> tuple[Poly, Poly]:
    """Coefficients of the polynomials of degree n and n - 1 on [-1, 1]."""
    return list(_legendre(n, False)), list(_legendre(n - 1, False)) if n else [Fraction(0)]


def shifted_legendre(n: int) -> Poly:
    """On [0, 1]."""
    return list(_legendre(n, True))


def basis_polynomial(n: int) -> Poly:
    """x (1 - x) P'_{n-1} / (n (n - 1)) for n of 2 at least, P the shifted Legendre polynomial."""
    if n < 2:
        raise InvalidArgumentError(f"basis polynomials start at 2: {n}")
    return [c / (n * (n - 1)) for c in product([Fraction(0), Fraction(1), Fraction(-1)], derivative(shifted_legendre(n - 1)))]


def _rounded(x: Fraction, bits: int = BITS) -> Fraction:
    return Fraction(round(x * (1 << bits)), 1 << bits)


def root(p: Poly, start: float, steps: int = 60) -> tuple[Fraction, Fraction]:
    """An enclosure of the root near ``start``: Newton at BITS bits, then a sign change on either side."""
    d, x = derivative(p), Fraction(start)
    for _ in range(steps):
        new = _rounded(x - value(p, x) / value(d, x))
        if abs(new - x) <= Fraction(1, 1 << BITS - 4):
            x = new
            break
        x = new
    e = Fraction(1, 1 << BITS - 16)
    if value(p, x - e) * value(p, x + e) > 0:
        raise VerificationError(f"no sign change at {float(x)}")
    return x - e, x + e


@cache
def gauss_legendre(n: int) -> tuple[tuple[Fraction, Fraction, Fraction, Fraction], ...]:
    """For each node on [-1, 1], rising: bounds of the node and of its weight, as rationals."""
    p, below = legendre(n)
    half = []
    for k in range(1, n // 2 + 1):
        lo, hi = root(p, math.cos(math.pi * (k - 0.25) / (n + 0.5)))
        # w = 2 (1 - x^2) / (n P_{n-1}(x))^2, with P_{n-1} bounded over the node's enclosure by its slope there.
        q, slope = value(below, lo), sum(abs(c) * k for k, c in enumerate(below))
        e = slope * (hi - lo)
        a, b = sorted((abs(q) - e, abs(q) + e))
        half.append((lo, hi, 2 * (1 - hi * hi) / (n * b) ** 2, 2 * (1 - lo * lo) / (n * a) ** 2))
    middle = []
    if n % 2:
        w = 2 / (n * value(below, Fraction(0))) ** 2
        middle = [(Fraction(0), Fraction(0), w, w)]
    return tuple([(-hi, -lo, a, b) for lo, hi, a, b in half] + middle + half[::-1])


def _down(x: Fraction) -> float:
    f = float(x)
    return f if Fraction(f) <= x else math.nextafter(f, -math.inf)


def _up(x: Fraction) -> float:
    f = float(x)
    return f if Fraction(f) >= x else math.nextafter(f, math.inf)


def nodes(spark: SparkSession, n: int) -> DataFrame:
    """(k, x_lo, x_hi, w_lo, w_hi) on [-1, 1]; one row a node."""
    rows = [(k, _down(a), _up(b), _down(c), _up(d)) for k, (a, b, c, d) in enumerate(gauss_legendre(n))]
    return spark.createDataFrame(rows, "k int, x_lo double, x_hi double, w_lo double, w_hi double")


def quadrature_order(m: int, p: int, mode: int, uh_order: int = -1) -> int:
    """Nodes on an axis for basis order m and power p, rounded up to an even number.

    mode 1: products with the basis; 2: residuals as well; 0: Goerisch
    integrals; above 2: approximation with 10 * mode nodes.
    """
    if m < 2 or p < 1 or mode < 0 or uh_order < -1 or uh_order == 0:
        raise InvalidArgumentError(f"order {m}, power {p}, mode {mode}, order of uh {uh_order}")
    if uh_order > 1 and mode not in (0, 1):
        raise StateError("an order of uh of its own needs mode 0 or 1")
    b, u = m + 2, uh_order + 2
    if mode == 1:
        n = max(((p - 1) * u + 2 * b + 2) // 2 + 2, (p * u + b + 2) // 2 + 2) if uh_order > 1 else (b * (p + 1) + 1) // 2 + 2
    elif mode == 2:
        n = (2 * b * p + 1) // 2 + 2
    elif mode == 0:
        n = max((2 * (p - 1) * u + 2 * b + 2) // 2 + 2, (2 * p * u + b + 2) // 2 + 2) if uh_order > 1 else (2 * b + 1) // 2 + 2
    else:
        n = 10 * mode
    return n + n % 2


def checked_power(base: int, exponent: int) -> int:
    out = base**exponent
    if out > 2**31 - 1:
        raise InvalidArgumentError(f"{base}**{exponent} does not fit in 32 bits")
    return out


@dataclasses.dataclass
class Basis:
    """Basis of order ``m`` on (0, 1)^``dim``, and functions uh of ``variables`` components in it.

    ``even`` keeps the functions of even index on each axis, which are the
    symmetric ones.  Components are set by set_uh(); functionals then integrate
    over a tensor grid of Gauss-Legendre nodes.
    """

    spark: SparkSession
    m: int
    p: int
    dim: int
    variables: int = 1
    mode: int = 2
    uh_order: int = -1
    even: bool = False

    def __post_init__(self) -> None:
        if self.dim < 1 or self.variables < 1:
            raise InvalidArgumentError(f"dimension {self.dim}, {self.variables} variables")
        self.n = quadrature_order(self.m, self.p, self.mode, self.uh_order)
        checked_power(self.n, self.dim)
        self.uh: DataFrame | None = None
        self.cx: DataFrame | None = None

    # --- lists and tables ---

    @property
    def axes(self) -> list[int]:
        return list(range(0, self.m, 2 if self.even else 1))

    @property
    def size(self) -> int:
        return checked_power(len(self.axes), self.dim)

    def index_list(self, order: int | None = None, even: bool | None = None) -> DataFrame:
        """(b, k0, k1, ...): one row a basis function, the first axis slowest."""
        step = 2 if (self.even if even is None else even) else 1
        per = len(range(0, order or self.m, step))
        b = self.spark.range(per**self.dim)
        return b.select(F.col("id").cast("int").alias("b"), *[(F.expr(f"id div {per ** (self.dim - 1 - d)}") % per * step).cast("int").alias(f"k{d}") for d in range(self.dim)])

    def as_matrix(self) -> Matrix:
        cells = F.explode(F.array(*[F.struct(F.lit(d).alias("j"), F.col(f"k{d}").alias("v")) for d in range(self.dim)])).alias("x")
        return Matrix(self.index_list().select(F.col("b").alias("i"), cells).select("i", "x.j", "x.v"), self.size, self.dim, "int")

    def axis_table(self, order: int | None = None) -> DataFrame:
        """(k, q, phi, lap): basis functions of one axis and their second derivatives at its nodes; m * n rows."""
        rows = []
        points = [(a + b) / 2 for a, b, _, _ in gauss_legendre(self.n)]
        for k in range(order or self.m):
            f = basis_polynomial(k + 2)
            g = derivative(derivative(f))
            rows += [(k, q, float(value(f, (x + 1) / 2)), float(value(g, (x + 1) / 2))) for q, x in enumerate(points)]
        return self.spark.createDataFrame(rows, "k int, q int, phi double, lap double")

    def grid(self) -> DataFrame:
        """(q, q0, ..., x0, ..., w): the tensor grid of nodes on (0, 1)^d and its weights."""
        g = gauss_legendre(self.n)
        one = self.spark.createDataFrame([(k, float((a + b + 2) / 4), float((c + d) / 4)) for k, (a, b, c, d) in enumerate(g)], "k int, x double, w double")
        q = self.spark.range(self.n**self.dim).select(F.col("id").alias("q"), *[(F.expr(f"id div {self.n ** (self.dim - 1 - d)}") % self.n).cast("int").alias(f"q{d}") for d in range(self.dim)])
        for d in range(self.dim):
            q = q.join(F.broadcast(one.toDF(f"q{d}", f"x{d}", f"w{d}")), f"q{d}")  # n rows
        w = F.lit(1.0)
        for d in range(self.dim):
            w = w * F.col(f"w{d}")
        return q.select("q", *[f"q{d}" for d in range(self.dim)], *[f"x{d}" for d in range(self.dim)], w.alias("w"))

    def at_nodes(self, order: int | None = None, even: bool | None = None) -> DataFrame:
        """(b, q, phi, lap) for every basis function and node."""
        t = self.axis_table(order)
        g = self.grid().select("q", *[f"q{d}" for d in range(self.dim)])
        d = self.index_list(order, even)
        for a in range(self.dim):
            d = d.join(F.broadcast(t.toDF(f"k{a}", f"q{a}", f"f{a}", f"g{a}")), f"k{a}")  # order * n rows
        f = [F.col(f"f{a}") for a in range(self.dim)]
        lap = F.lit(0.0)
        for a in range(self.dim):
            term = F.col(f"g{a}")
            for c in range(self.dim):
                if c != a:
                    term = term * f[c]
            lap = lap + term
        phi = F.lit(1.0)
        for x in f:
            phi = phi * x
        return d.join(F.broadcast(g), [f"q{a}" for a in range(self.dim)]).select("b", "q", phi.alias("phi"), lap.alias("lap"))

    # --- components ---

    def set_uh(self, coefficients: DataFrame | None = None, order: int | None = None, even: bool | None = None) -> Basis:
        """Components from (b, var, u); without them, all coefficients 1.  An order and list of their own need mode 0 or 1."""
        if coefficients is None:
            coefficients = self.index_list(order, even).select("b", F.explode(F.sequence(F.lit(0), F.lit(self.variables - 1))).alias("var"), F.lit(1.0).alias("u"))
        self.uh = self._tabulated(coefficients, order, even)
        return self

    def set_cx(self, coefficients: DataFrame, order: int | None = None, even: bool | None = None) -> Basis:
        """The coefficient function of the Goerisch integrals (mode 0)."""
        if self.mode != 0:
            raise StateError("a coefficient function needs mode 0")
        self.cx = self._tabulated(coefficients.withColumn("var", F.lit(0)), order, even)
        return self

    def _tabulated(self, c: DataFrame, order: int | None, even: bool | None) -> DataFrame:
        t = self.at_nodes(order, even).join(c, "b")
        return t.groupBy("q", "var").agg(F.sum(F.col("phi") * F.col("u")).alias("u"), F.sum(F.col("lap") * F.col("u")).alias("lap"))

    def _values(self, table: DataFrame | None, name: str) -> DataFrame:
        if table is None:
            raise StateError(f"{name} is not set")
        return table.groupBy("q").agg(*[F.max(F.when(F.col("var") == v, F.col(c))).alias(f"{c}{v}") for v in range(self.variables) for c in ("u", "lap")])

    def _monomial(self, powers: tuple[int, ...]) -> Column:
        if len(powers) != self.variables:
            raise DimensionError(f"{len(powers)} powers for {self.variables} variables")
        out = F.lit(1.0)
        for v, n in enumerate(powers):
            if n:
                out = out * X.int_pow(F.col(f"u{v}"), n)
        return out

    def _at(self) -> DataFrame:
        return self.grid().select("q", *[f"x{d}" for d in range(self.dim)], "w").join(self._values(self.uh, "uh"), "q")

    # --- closed forms ---

    def _pairs(self) -> DataFrame:
        i = self.index_list().toDF("i", *[f"a{d}" for d in range(self.dim)])
        j = self.index_list().toDF("j", *[f"b{d}" for d in range(self.dim)])
        return i.join(j, how="cross")  # the matrix itself has these rows

    @staticmethod
    def _mass(a: Column, b: Column) -> Column:
        k = F.least(a, b).cast("double")
        same = F.lit(1.0) / (2 * (2 * k + 1) * (2 * k + 5) * (2 * k + 3))
        return F.when(a == b, same).when(F.abs(a - b) == 2, F.lit(-1.0) / (4 * (2 * k + 5) * (2 * k + 7) * (2 * k + 3))).otherwise(0.0)

    @staticmethod
    def _stiff(a: Column, b: Column) -> Column:
        return F.when(a == b, F.lit(1.0) / (2 * a.cast("double") + 3)).otherwise(0.0)

    def mass(self) -> Matrix:
        """(phi_i, phi_j): a product over the axes."""
        v = F.lit(1.0)
        for d in range(self.dim):
            v = v * self._mass(F.col(f"a{d}"), F.col(f"b{d}"))
        return Matrix(self._pairs().select("i", "j", v.alias("v")), self.size, self.size)

    def stiffness(self) -> Matrix:
        """(grad phi_i, grad phi_j): a sum over the axes."""
        if self.mode in (0, 2):
            raise StateError("the stiffness matrix needs mode 1 or an approximation mode")
        v = F.lit(0.0)
        for d in range(self.dim):
            t = self._stiff(F.col(f"a{d}"), F.col(f"b{d}"))
            for c in range(self.dim):
                if c != d:
                    t = t * self._mass(F.col(f"a{c}"), F.col(f"b{c}"))
            v = v + t
        return Matrix(self._pairs().select("i", "j", v.alias("v")), self.size, self.size)

    # --- quadrature ---

    def weighted_mass(self, *powers: int) -> Matrix:
        """(u^p phi_i, phi_j)."""
        d = self._at().select("q", (F.col("w") * self._monomial(powers)).alias("w"))
        t = self.at_nodes().select("b", "q", "phi")
        half = t.toDF("i", "q", "x").join(d, "q").join(t.toDF("j", "q", "y"), "q").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("x") * F.col("y")).alias("v"))
        both = F.explode(F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j"))))
        return Matrix(half.select(both.alias("at"), "v").select("at.i", "at.j", "v"), self.size, self.size)

    def load(self, *powers: int) -> Matrix:
        """(u^p, phi_j); without powers (1, phi_j)."""
        d = self._at() if powers else self.grid()
        d = d.select("q", (F.col("w") * self._monomial(powers) if powers else F.col("w")).alias("w"))
        v = self.at_nodes().join(d, "q").groupBy(F.col("b").alias("i")).agg(F.sum(F.col("w") * F.col("phi")).alias("v"))
        return Matrix(v.select("i", F.lit(0).alias("j"), "v"), self.size, 1)

    def _integral(self, f: Column, d: DataFrame | None = None) -> DataFrame:
        return (self._at() if d is None else d).agg(F.sum(F.col("w") * f).alias("v"))

    def integral_u(self, *powers: int) -> DataFrame:
        return self._integral(self._monomial(powers))

    def integral_laplacians(self, a: int = 0, b: int | None = None) -> DataFrame:
        """Of the product of two components' Laplacians, or the square of one's."""
        return self._integral(F.col(f"lap{a}") * F.col(f"lap{a if b is None else b}"))

    def integral_laplacian_u(self, v: int, *powers: int) -> DataFrame:
        if self.mode != 2:
            raise StateError("this integral needs mode 2")
        return self._integral(F.col(f"lap{v}") * self._monomial(powers))

    def _goerisch(self) -> DataFrame:
        c = self._values(self.cx, "cx").select("q", F.col("u0").alias("c"))
        return self._at().join(c, "q")

    def integral_laplacian_cx_u(self, v: int = 0) -> DataFrame:
        return self._integral(F.col(f"lap{v}") * F.col("c") * F.col(f"u{v}"), self._goerisch())

    def integral_cx_u_u(self, a: int = 0, b: int = 0) -> DataFrame:
        return self._integral(F.col("c") * F.col("c") * F.col(f"u{a}") * F.col(f"u{b}"), self._goerisch())

    # --- evaluation ---

    def evaluate(self, points: DataFrame, coefficients: DataFrame) -> DataFrame:
        """``points`` (x0, x1, ...) with u for each var of (b, var, u)."""
        coef = F.lit(None)
        table = self.spark.createDataFrame([(k, [float(c) for c in basis_polynomial(k + 2)]) for k in range(self.m)], "k int, c array<double>")
        d = self.index_list().join(coefficients, "b")
        xs = [f"x{a}" for a in range(self.dim)]
        for a in range(self.dim):
            d = d.join(F.broadcast(table.toDF(f"k{a}", f"c{a}")), f"k{a}")  # m rows
        coef = F.col("u")
        d = points.select(*xs).distinct().join(d, how="cross")  # each point needs each coefficient
        for a in range(self.dim):
            coef = coef * X.horner(F.col(f"c{a}"), F.col(f"x{a}"))
        return d.groupBy(*xs, "var").agg(F.sum(coef).alias("u"))

    def sampled(self, coefficients: DataFrame, divisions: int = 100) -> DataFrame:
        """Values on a uniform grid, for plotting."""
        if self.mode < 3:
            raise StateError("sampling needs an approximation mode")
        n = divisions + 1
        pts = self.spark.range(n**self.dim).select(*[(F.expr(f"id div {n**d}") % n / float(divisions)).alias(f"x{d}") for d in range(self.dim)])
        return self.evaluate(pts, coefficients)


# --- constants -----------------------------------------------------------------

Bounds = tuple[float, float]
PI: Bounds = (3.141592653589793, 3.1415926535897936)


def _out(lo: float, hi: float) -> Bounds:
    return math.nextafter(lo, -math.inf), math.nextafter(hi, math.inf)


def _plus(a: Bounds, b: Bounds) -> Bounds:
    return _out(a[0] + b[0], a[1] + b[1])


def _times(a: Bounds, b: Bounds) -> Bounds:
    """Of positive bounds."""
    return _out(a[0] * b[0], a[1] * b[1])


def _inverse(a: Bounds) -> Bounds:
    return _out(1 / a[1], 1 / a[0])


def _root(a: Bounds) -> Bounds:
    return _out(math.sqrt(a[0]), math.sqrt(a[1]))


def _point(x: float) -> Bounds:
    return float(x), float(x)


def _row(spark: SparkSession, x: Bounds) -> DataFrame:
    return spark.createDataFrame([x], "lo double, hi double")


def _weight(weight: float | None) -> Bounds:
    if weight is not None and weight < 0:
        raise InvalidArgumentError(f"weight {weight}")
    return _point(weight or 0.0)


def ritz_constant(spark: SparkSession, n: int, weight: float | None = None) -> DataFrame:
    """(lo, hi): the constant of the Ritz projection onto order n, in the norm with ``weight`` if given."""
    if n < 2:
        raise InvalidArgumentError(f"order {n}")
    w, s = _weight(weight), {k: _root(_point(2 * n + k)) for k in (3, 7, 11)}

    def plain(a: int, b: int) -> Bounds:
        return _inverse(_point(2 * a * b))

    def mixed(a: int, p: int, q: int) -> Bounds:
        return _inverse(_times(_point(4 * a), _times(s[p], s[q])))

    first = _plus(plain(2 * n + 1, 2 * n + 5), mixed(2 * n + 5, 3, 7))
    second = _plus(_plus(mixed(2 * n + 5, 3, 7), plain(2 * n + 5, 2 * n + 9)), mixed(2 * n + 9, 7, 11))
    c = _root((max(first[0], second[0]), max(first[1], second[1])))
    if weight is not None:
        c = _times(c, _root(_plus(_point(1), _times(w, _times(c, c)))))
    return _row(spark, c)


def poincare_constant(spark: SparkSession, dim: int, weight: float | None = None) -> DataFrame:
    w = _weight(weight)
    if weight is None:
        return _row(spark, _inverse(_times(_root(_point(dim)), PI)))
    return _row(spark, _inverse(_root(_plus(_times(_point(dim), _times(PI, PI)), w))))


def _spread(x: float, units: int = 64) -> tuple[float, float]:
    """x, from a formula of a few library functions, with room for their errors."""
    return x - abs(x) * units * 2.0**-53, x + abs(x) * units * 2.0**-53


def sobolev_constant(spark: SparkSession, dim: int, p: float, weight: float | None = None) -> DataFrame:
    """(lo, hi): a constant C with |u|_p <= C |grad u|_2 on (0, 1)^dim, or C (|grad u|^2 + weight |u|^2)^(1/2).

    In one dimension the weight is not used; the constant holds for any.
    """
    n = float(dim)
    _weight(weight)
    if dim < 1:
        raise DimensionError(f"dimension {dim}")
    least = 0.0 if dim == 1 else 2.0 if dim == 2 or weight is not None else n / (n - 1)
    if p <= least or dim > 2 and p > 2 * n / (n - 2):
        raise DomainError(f"no such constant for p = {p} in dimension {dim}")
    if dim == 1:
        c = (2 / (p + 2)) ** (1 / p)
    elif weight is None:
        q = n * p / (n + p)
        g = math.lgamma(1 + n / 2) + math.lgamma(n) - math.lgamma(n / q) - math.lgamma(1 + n - n / q)
        c = math.pi**-0.5 * n ** (-1 / q) * ((q - 1) / (n - q)) ** (1 - 1 / q) * math.exp(g / n)
    elif dim == 2:
        nu = int(p / 2)
        s = 1.0 if nu == 1 else math.prod(p / 2 - i for i in range(nu - 1)) ** (2 / p)
        c = 0.5 ** (0.5 + (2 * nu - 3) / p) * s / (dim * math.pi**2 + p / 2 * weight) ** (1 / p)
    else:
        s = max(0.0, n * (1 / p - 0.5 + 1 / n))
        c = ((n - 1) / (math.sqrt(n) * (n - 2))) ** (1 - s) * (s / (s * dim * math.pi**2 + weight)) ** (s / 2)
    return _row(spark, _spread(c))


# --- branch and bound ----------------------------------------------------------


def global_minimum(spark: SparkSession, f, box: list[tuple[float, float]], mesh: float = 2.0**-11, largest: bool = False) -> tuple[float, float]:
    """A lower bound of the minimum of f over a box, and the best value found (bounds from above with ``largest``).

    ``f`` maps interval columns [(lo, hi), ...] to an interval.  All boxes of a
    level are one DataFrame: those that cannot hold the minimum are dropped by
    the best bound at a midpoint so far, the others are halved on every axis,
    until their first axis is below ``mesh``.  Two numbers a level come to the
    driver.
    """
    sign = -1.0 if largest else 1.0

    def g(x):
        lo, hi = f(x)
        return (-hi, -lo) if largest else (lo, hi)

    dims = range(len(box))
    d = spark.createDataFrame([tuple(v for x in box for v in x)], ", ".join(f"a{k} double, b{k} double" for k in dims))
    best, width = math.inf, box[0][1] - box[0][0]
    from enclosa.plans.iterate import settled_frame

    while True:
        middle = [(F.col(f"a{k}") + F.col(f"b{k}")) / 2 for k in dims]
        whole = g([(F.col(f"a{k}"), F.col(f"b{k}")) for k in dims])
        centre = g([(x, x) for x in middle])
        d = settled_frame(d.withColumn("f_lo", whole[0]).withColumn("m_hi", centre[1]))
        best = min(best, d.agg(F.min("m_hi")).first()[0])
        d = d.where(F.col("f_lo") <= best)
        if width < mesh:
            return sign * d.agg(F.min("f_lo")).first()[0], sign * best
        halves = [F.array(F.struct(F.col(f"a{k}").alias("a"), middle[k].alias("b")), F.struct(middle[k].alias("a"), F.col(f"b{k}").alias("b"))) for k in dims]
        for k in dims:
            d = d.withColumn(f"h{k}", F.explode(halves[k]))
        d = d.select(*[F.col(f"h{k}.{c}").alias(f"{c}{k}") for k in dims for c in "ab"])
        width /= 2


def global_maximum(spark: SparkSession, f, box: list[tuple[float, float]], mesh: float = 2.0**-11) -> tuple[float, float]:
    return global_minimum(spark, f, box, mesh, largest=True)
