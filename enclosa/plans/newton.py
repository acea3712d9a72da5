"""Newton's method: for one system over DataFrames, and for a column of independent scalars."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from enclosa.operators.elementwise import subtract
from enclosa.operators.solve import solve
from enclosa.plans.iterate import settled
from enclosa.types import Matrix

EPSILON = 2.0**-52


@dataclasses.dataclass
class Newton:
    """x from f(x) = 0 with derivative df(x), both matrices; stops where the step is within ``tolerance`` of x.

    ``prepare`` is called with x before f and df, each step.  The last iterate
    is returned in any case; ``converged`` says whether it settled.
    """

    f: Callable[[Matrix], Matrix]
    df: Callable[[Matrix], Matrix]
    prepare: Callable[[Matrix], None] | None = None
    tolerance: float = 4 * EPSILON
    steps: int = 100
    converged: bool = False

    def tolerate(self, units: int) -> Newton:
        self.tolerance = units * EPSILON
        return self

    def solve(self, x: Matrix) -> Matrix:
        self.converged = False
        for _ in range(self.steps):
            if self.prepare is not None:
                self.prepare(x)
            d = settled(solve(self.df(x), self.f(x)))
            x = settled(subtract(x, d))
            step, size = (m.df.agg(F.max(F.abs(F.col(m.values[0])))).first()[0] for m in (d, x))
            if step <= self.tolerance * size:
                self.converged = True
                break
        return x


def newton_column(start: Column, f: Callable[[Column], Column], df: Callable[[Column], Column], steps: int = 40) -> Column:
    """The root for each row: a fixed number of steps inside one expression, which stops moving once it has settled."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start.cast("double"), lambda x, _: x - f(x) / df(x))
