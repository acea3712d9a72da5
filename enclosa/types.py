"""The matrix handle, element kinds and errors."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MatrixError(Exception):
    """Base of all errors of this library."""


class InvalidArgumentError(MatrixError):
    pass


class DimensionError(MatrixError):
    pass


class IndexRangeError(MatrixError):
    pass


class StateError(MatrixError):
    pass


class DomainError(MatrixError):
    pass


class NumericalError(MatrixError):
    pass


class VerificationError(NumericalError):
    pass


class BackendError(NumericalError):
    pass


class BlasError(BackendError):
    def __init__(self, routine: str, info: int):
        super().__init__(f"{routine}: info = {info}")
        self.routine, self.info = routine, info


class LapackError(BlasError):
    pass


class FileError(MatrixError):
    pass


def throw(kind: type[MatrixError], *parts: object) -> None:
    """Raises ``kind`` with its parts written one after another."""
    raise kind("".join(map(str, parts)))


#: Value columns of each element kind.
VALUES = {"double": ("v",), "int": ("v",), "bool": ("v",), "interval": ("lo", "hi"), "dd": ("hi", "lo"), "poly": ("c",), "interval_dd": ("lo_hi", "lo_lo", "hi_hi", "hi_lo")}
SQL_TYPES = {"double": "double", "int": "int", "bool": "boolean", "interval": "double", "dd": "double", "poly": "array<double>", "interval_dd": "double"}


def is_interval(elem: str) -> bool:
    return elem in ("interval", "interval_dd")


def is_ordered(elem: str) -> bool:
    """Whether elements compare; polynomials don't, so they have no comparisons, solvers or eigenvalues."""
    return elem not in ("poly",)


def is_poly(elem: str) -> bool:
    return elem == "poly"


@dataclasses.dataclass(frozen=True)
class Matrix:
    """A dense matrix, or one for each value of the columns ``by``, in long form.

    ``df`` has the columns ``by``, ``i``, ``j`` (from 0) and the value columns of
    ``elem``; every element has a row.  The shape is known to the driver, so
    operators check it before they plan anything.
    """

    df: DataFrame
    rows: int
    cols: int
    elem: str = "double"
    by: tuple[str, ...] = ()

    @property
    def values(self) -> tuple[str, ...]:
        return VALUES[self.elem]

    @property
    def keys(self) -> list[str]:
        return [*self.by, "i", "j"]

    @property
    def kind(self) -> str:
        """N: null, S: scalar, R: row, C: column, M: matrix."""
        if self.rows == 0 or self.cols == 0:
            return "N"
        if self.rows == 1:
            return "S" if self.cols == 1 else "R"
        return "C" if self.cols == 1 else "M"

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    @property
    def size(self) -> int:
        return self.rows * self.cols

    @property
    def length(self) -> int:
        return max(self.rows, self.cols)

    def like(self, df: DataFrame, rows: int | None = None, cols: int | None = None, elem: str | None = None) -> Matrix:
        m = Matrix(df, self.rows if rows is None else rows, self.cols if cols is None else cols, elem or self.elem, self.by)
        return dataclasses.replace(m, df=df.select(*m.keys, *m.values))

    def at(self, i: int, j: int | None = None) -> DataFrame:
        """The element at (i, j); of a vector, at its one index."""
        if j is None:
            i, j = (0, i) if self.kind in "RS" else (i, 0)
        return self.df.where((F.col("i") == i) & (F.col("j") == j))

    def element(self, i: int, j: int | None = None):
        """The value at (i, j) on the driver; a tuple for kinds of several columns."""
        r = self.at(i, j).select(*self.values).first()
        if r is None:
            raise IndexRangeError(f"no element ({i}, {j}) in a {self.rows} x {self.cols} matrix")
        return r[0] if len(r) == 1 else tuple(r)

    def collect(self):
        """The elements as a numpy array on the driver, for matrices that fit there; one trailing axis for the value columns."""
        import numpy as np

        if self.by:
            raise StateError("collect() is for one matrix, not for one for each key")
        out = np.empty((self.rows, self.cols, len(self.values)), dtype=object if self.elem == "poly" else bool if self.elem == "bool" else float)
        for r in self.df.select("i", "j", *self.values).collect():
            for k, c in enumerate(self.values):
                out[r["i"], r["j"], k] = r[c]
        return out[:, :, 0] if len(self.values) == 1 else out

    def display(self) -> DataFrame:
        """Rows in order, each as one text of its elements in order."""
        if self.kind == "N":
            raise StateError("display of a null matrix")
        cell = F.concat_ws(" ", *[F.col(c).cast("string") for c in self.values])
        lines = self.df.select(*self.by, "i", "j", cell.alias("cell")).groupBy(*self.by, "i").agg(F.sort_array(F.collect_list(F.struct("j", "cell"))).alias("cells"))
        return lines.select(*self.by, "i", F.array_join(F.col("cells.cell"), "  ").alias("line")).orderBy(*self.by, "i")

    def clear(self) -> Matrix:
        """A null matrix; cached data is let go."""
        self.df.unpersist()
        return Matrix(self.df.limit(0), 0, 0, self.elem, self.by)

    def need(self, ok: bool, what: str) -> None:
        if not ok:
            raise DimensionError(f"{what}: {self.rows} x {self.cols}")


def same_shape(a: Matrix, b: Matrix, what: str) -> None:
    if a.shape != b.shape:
        raise DimensionError(f"{what}: {a.rows} x {a.cols} and {b.rows} x {b.cols}")
    if a.by != b.by:
        raise DimensionError(f"{what}: keys {a.by} and {b.by}")
