"""Existence of a solution near an approximate one: -Laplace(u) = u^2 on (0, 1)^d with zero boundary values.

The parts in order: Newton's method in the Legendre basis, the residual, a
bound of the linearised operator's inverse from verified eigenvalues, the
Lipschitz constant of the derivative, and the Newton-Kantorovich test.  Sums of
quadrature in doubles enter with a bound of their rounding.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enclosa.operators import elementwise, legendre, product, verify
from enclosa.plans.iterate import settled
from enclosa.plans.newton import Newton
from enclosa.types import Matrix, VerificationError

#: Rounding of a sum of quadrature, relative to the sum of its terms' magnitudes.
ROUNDING = 2.0**-40


@dataclasses.dataclass(frozen=True)
class Certificate:
    """``top``: the value in the centre; ``inverse``, ``residual`` and ``lipschitz`` bounds; ``radius`` of the ball that holds a solution, infinite without one."""

    top: float
    inverse: float
    residual: float
    lipschitz: float
    radius: float

    @property
    def holds(self) -> bool:
        return math.isfinite(self.radius)


def _upper(d: DataFrame) -> float:
    return float(d.select("hi").first()[0])


def approximate(spark: SparkSession, dim: int, order: int, height: float) -> tuple[legendre.Basis, Matrix]:
    """The symmetric solution in the basis, by Newton's method from ``height`` times the first basis function."""
    b = legendre.Basis(spark, order, 2, dim, mode=max(3, -(-3 * order // 20) + 1), even=True)
    stiff = settled(b.stiffness())
    start = stiff.like(b.index_list().select(F.col("b").alias("i"), F.lit(0).alias("j"), F.when(F.col("b") == 0, float(height)).otherwise(0.0).alias("v")), b.size, 1)

    def prepare(x: Matrix) -> None:
        b.set_uh(coefficients(x))

    rest = lambda x: elementwise.subtract(product.matmul(stiff, x), b.load(2))
    slope = lambda x: elementwise.subtract(stiff, elementwise.scale(2.0, b.weighted_mass(1)))
    newton = Newton(rest, slope, prepare, tolerance=1e-13, steps=30)
    x = newton.solve(start)
    if not newton.converged:
        raise VerificationError("Newton's method does not settle")
    return b.set_uh(coefficients(x)), x


def coefficients(x: Matrix) -> DataFrame:
    return x.df.select(F.col("i").alias("b"), F.lit(0).alias("var"), F.col("v").alias("u"))


def emden(spark: SparkSession, dim: int, order: int, height: float) -> Certificate:
    b, x = approximate(spark, dim, order, height)
    centre = spark.createDataFrame([(0.5,) * dim], ", ".join(f"x{k} double" for k in range(dim)))
    top = float(b.evaluate(centre, coefficients(x)).first()["u"])
    greatest = float(b._at().agg(F.max(F.abs("u0"))).first()[0]) * (1 + 1e-3) + abs(top) * 1e-6

    full = legendre.Basis(spark, order, 2, dim, mode=2, even=True).set_uh(coefficients(x))
    parts = [float(d.first()["v"]) for d in (full.integral_laplacians(), full.integral_laplacian_u(0, 2), full.integral_u(4))]
    square = abs(parts[0] + 2 * parts[1] + parts[2]) + ROUNDING * (abs(parts[0]) + 2 * abs(parts[1]) + abs(parts[2]))
    residual = _upper(legendre.poincare_constant(spark, dim)) * math.sqrt(square)

    # Eigenvalues of -Laplace(v) = e 2 u v: Ritz values from above, and below by the error of the projection.
    w = elementwise.scale(2.0, b.weighted_mass(1))
    size = float(w.df.agg(F.max(F.abs("v"))).first()[0])
    blur = elementwise.mapped(w, lambda v: (v[0] - ROUNDING * size, v[0] + ROUNDING * size), "interval")
    e = verify.verified_eigsymge(elementwise.convert(b.stiffness(), "interval"), blur).df.where("i = j")
    c = _upper(legendre.ritz_constant(spark, order)) ** 2 * 2 * greatest
    low = F.col("lo") / (1 + c * F.col("lo"))
    ends = [F.abs(v / (1 - v)) for v in (low, F.col("hi"))]
    inverse, crossed = e.agg(F.max(F.greatest(*ends)), F.max(((low <= 1) & (F.col("hi") >= 1)).cast("int"))).first()
    inverse = math.inf if crossed else max(1.0, float(inverse)) * (1 + 2.0**-40)

    lipschitz = 2 * _upper(legendre.sobolev_constant(spark, dim, 3.0)) ** 3
    alpha, omega = inverse * residual, inverse * lipschitz
    radius = (1 - math.sqrt(1 - 2 * alpha * omega)) / omega if alpha * omega <= 0.5 else math.inf
    return Certificate(top, inverse, residual, lipschitz, radius)
