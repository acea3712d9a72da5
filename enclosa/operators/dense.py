"""Dense factorisations of one small matrix, in numpy.

These run inside a group of a grouped function: thousands of small systems
scale out over their keys.
"""

from __future__ import annotations

import numpy as np

from enclosa.types import DimensionError, DomainError, NumericalError


def square(a: np.ndarray) -> None:
    if a.shape[0] != a.shape[1]:
        raise DimensionError(f"a square matrix is needed: {a.shape[0]} x {a.shape[1]}")


def lu(a: np.ndarray, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed L and U of the rows in pivot order, and the order; the first row of greatest magnitude is the pivot.

    With ``band``, only that many rows below the diagonal can hold a pivot.
    """
    square(a)
    a, n = a.astype(float).copy(), len(a)
    order = np.arange(n)
    for k in range(n):
        end = n if band is None else min(n, k + band + 1)
        p = k + int(np.argmax(np.abs(a[k:end, k])))
        if a[p, k] == 0:
            raise NumericalError(f"the matrix is singular at column {k}")
        if p != k:
            a[[k, p]], order[[k, p]] = a[[p, k]], order[[p, k]]
        a[k + 1 : end, k] /= a[k, k]
        a[k + 1 : end, k + 1 :] -= np.outer(a[k + 1 : end, k], a[k, k + 1 :])
    return a, order


def split(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.tril(packed, -1) + np.eye(len(packed)), np.triu(packed)


def substituted(packed: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b[order].astype(float).copy()
    n = len(packed)
    for i in range(n):
        x[i] -= packed[i, :i] @ x[:i]
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - packed[i, i + 1 :] @ x[i + 1 :]) / packed[i, i]
    return x


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square(a)
    if len(a) != len(b):
        raise DimensionError(f"{len(a)} equations and {len(b)} right-hand sides")
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError as e:
        raise NumericalError(str(e)) from None


def inverse(a: np.ndarray) -> np.ndarray:
    return solve(a, np.eye(len(a)))


def cholesky(a: np.ndarray) -> np.ndarray:
    """The upper factor; raises where the matrix is not symmetric or not positive definite."""
    square(a)
    if not np.array_equal(a, a.T):
        raise DomainError("Cholesky of a matrix that is not symmetric")
    try:
        return np.linalg.cholesky(a).T
    except np.linalg.LinAlgError:
        raise NumericalError("Cholesky of a matrix that is not positive definite") from None


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and 2 / v.v of the reflection that takes x to a multiple of the first unit vector, of opposite sign."""
    v = x.astype(float).copy()
    size = np.linalg.norm(v)
    if size == 0 or not v[1:].any():
        return v, 0.0
    v[0] += size if v[0] >= 0 else -size
    return v, 2 / (v @ v)


def qr(a: np.ndarray, structure: str = "full") -> tuple[np.ndarray, np.ndarray]:
    """Q and R by Householder reflections; for ``hessenberg`` and ``tridiagonal`` matrices by rotations of two rows."""
    m, n = a.shape
    r, q = a.astype(float).copy(), np.eye(m)
    if structure == "full":
        for k in range(min(m - 1, n)):
            v, t = _reflector(r[k:, k])
            r[k:, k:] -= t * np.outer(v, v @ r[k:, k:])
            q[:, k:] -= t * np.outer(q[:, k:] @ v, v)
    else:
        for k in range(min(m - 1, n)):
            h = np.hypot(r[k, k], r[k + 1, k])
            if h:
                c, s = r[k, k] / h, r[k + 1, k] / h
                end = n if structure == "hessenberg" else min(n, k + 3)
                r[k : k + 2, k:end] = np.array([[c, s], [-s, c]]) @ r[k : k + 2, k:end]
                q[:, k : k + 2] = q[:, k : k + 2] @ np.array([[c, -s], [s, c]])
    return q, np.triu(r)


def hessenberg(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H and Q with A = Q H Q'; of a symmetric matrix, H is tridiagonal."""
    square(a)
    h, q = a.astype(float).copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v, t = _reflector(h[k + 1 :, k])
        h[k + 1 :] -= t * np.outer(v, v @ h[k + 1 :])
        h[:, k + 1 :] -= t * np.outer(h[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= t * np.outer(q[:, k + 1 :] @ v, v)
        h[k + 2 :, k] = 0
    return h, q


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not np.array_equal(a, a.T):
        raise DomainError("tridiagonalisation of a matrix that is not symmetric")
    t, q = hessenberg(a)
    off = (np.diag(t, 1) + np.diag(t, -1)) / 2
    return np.diag(np.diag(t)) + np.diag(off, 1) + np.diag(off, -1), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in rising order, and vectors whose component of greatest magnitude is positive."""
    square(a)
    if not np.array_equal(a, a.T):
        raise DomainError("symmetric eigenproblem of a matrix that is not symmetric")
    e, v = np.linalg.eigh(a)
    top = np.abs(np.round(v, 12)).argmax(0)
    return e, v * np.where(v[top, np.arange(len(e))] < 0, -1.0, 1.0)


def eigen_general(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A x = lambda B x by the Cholesky factor of B."""
    w = inverse(cholesky(b))
    c = w.T @ a @ w
    e, v = eigen((c + c.T) / 2)
    x = w @ v
    top = np.abs(np.round(x, 12)).argmax(0)
    return e, x * np.where(x[top, np.arange(len(e))] < 0, -1.0, 1.0)
