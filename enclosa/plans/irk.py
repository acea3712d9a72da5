"""Implicit Runge-Kutta with Gauss-Legendre nodes, for many trajectories at once.

One trajectory is sequential, so the axis that scales is their number: each
row of initial values is integrated in its task, and the result has a row for
each step and component.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from enclosa.operators.legendre import gauss_legendre, integral, product, value
from enclosa.types import InvalidArgumentError

SCHEMA = "traj long, step int, t double, comp int, x double"


@cache
def tableau(n: int) -> tuple[list[list[float]], list[float], list[float]]:
    """a, b and c of n stages (an even number; an odd one is raised), of order 2n."""
    if n < 3:
        raise InvalidArgumentError(f"{n} stages")
    n += n % 2
    c = [((lo + hi) / 2 + 1) / 2 for lo, hi, _, _ in gauss_legendre(n)]
    c = [Fraction(round(x * (1 << 160)), 1 << 160) for x in c]
    a, b = [[0.0] * n for _ in range(n)], []
    for j in range(n):
        p = [Fraction(1)]
        for k in range(n):
            if k != j:
                p = product(p, [-c[k] / (c[j] - c[k]), 1 / (c[j] - c[k])])
        q = integral(p)
        b.append(float(value(q, Fraction(1))))
        for i in range(n):
            a[i][j] = float(value(q, c[i]))
    return a, b, [float(x) for x in c]


@dataclasses.dataclass
class ImplicitRungeKutta:
    """x' = f(t, x) with Jacobian df(t, x), from t0 to t1 in steps of tau.

    With ``refine``, a step whose Newton iteration fails is taken again with
    half of tau, which then stays; otherwise the trajectory ends there.
    """

    f: Callable[[float, np.ndarray], np.ndarray]
    df: Callable[[float, np.ndarray], np.ndarray]
    stages: int = 4
    tau: float = 0.125
    t0: float = 0.0
    t1: float = 1.0
    refine: bool = True
    newton_steps: int = 100
    tolerance: float = 4 * 2.0**-52

    def with_step(self, tau: float) -> ImplicitRungeKutta:
        return dataclasses.replace(self, tau=tau)

    def with_span(self, t0: float, t1: float) -> ImplicitRungeKutta:
        return dataclasses.replace(self, t0=t0, t1=t1)

    def with_order(self, stages: int) -> ImplicitRungeKutta:
        return dataclasses.replace(self, stages=stages)

    def step(self, t: float, x: np.ndarray, tau: float) -> np.ndarray | None:
        """One step, or None where Newton does not settle."""
        a, b, c = (np.array(v) for v in tableau(self.stages))
        n, d = len(b), len(x)
        z = np.tile(x, (n, 1))
        at = t + c * tau
        for _ in range(self.newton_steps):
            k = np.stack([self.f(s, y) for s, y in zip(at, z, strict=True)])
            rest = (z - x - tau * (a @ k)).ravel()
            jac = np.stack([self.df(s, y) for s, y in zip(at, z, strict=True)])
            big = np.eye(n * d) - tau * np.einsum("ij,jkl->ikjl", a, jac).reshape(n * d, n * d)
            move = np.linalg.solve(big, rest).reshape(n, d)
            z = z - move
            if not np.isfinite(z).all():
                return None
            if np.abs(move).max() <= self.tolerance * max(np.abs(z).max(), 1e-300) * 4:
                return x + tau * (b @ np.stack([self.f(s, y) for s, y in zip(at, z, strict=True)]))
        return None

    def trajectory(self, x: np.ndarray) -> list[tuple[int, float, np.ndarray]]:
        t, tau, k = self.t0, self.tau, 0
        out = [(0, t, x)]
        while t < self.t1 - 1e-12 * max(1.0, abs(self.t1)):
            tau = min(tau, self.t1 - t) if t + tau > self.t1 else tau
            new = self.step(t, x, tau)
            if new is None:
                if not self.refine or tau < 1e-12:
                    break
                tau /= 2
                continue
            k, t, x = k + 1, t + tau, new
            out.append((k, t, x))
        return out

    def solve(self, starts: DataFrame, key: str, columns: list[str]) -> DataFrame:
        """(traj, step, t, comp, x) for every row of ``starts``."""

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for r in f.itertuples(index=False):
                    for k, t, x in self.trajectory(np.array(r[1:], float)):
                        rows += [(r[0], k, t, c, v) for c, v in enumerate(x.tolist())]
                yield pd.DataFrame(rows, columns=["traj", "step", "t", "comp", "x"]).astype({"step": np.int32, "comp": np.int32})

        return starts.selectExpr(f"CAST({key} AS LONG) AS traj", *columns).mapInPandas(part, SCHEMA)
