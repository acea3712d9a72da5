"""Matrices against numpy and exact rationals."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest
from enclosa.functions import expr as X
from enclosa.operators import build, elementwise, fourier, legendre, product, reshape, solve, verify
from enclosa.operators import reduce as red
from enclosa.plans.irk import ImplicitRungeKutta, tableau
from enclosa.plans.newton import Newton
from enclosa.plans.timer import Timer
from enclosa.sources import matrix_file as mf
from enclosa.types import DimensionError, DomainError, FileError, IndexRangeError, InvalidArgumentError, LapackError, Matrix, MatrixError, NumericalError, StateError, VerificationError, is_interval, is_ordered, is_poly, throw
from pyspark.sql import functions as F


def of(spark, x) -> Matrix:
    x = np.atleast_2d(np.asarray(x, float))
    rows = [(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return Matrix(spark.createDataFrame(rows, "i int, j int, v double"), *x.shape)


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


@pytest.fixture(scope="module")
def a(spark, rng):
    return rng.normal(size=(6, 6))


def test_kinds_and_shapes(spark):
    assert [build.zeros(spark, *s).kind for s in ((1, 1), (1, 3), (3, 1), (2, 2), (0, 0))] == list("SRCMN")
    z = build.ones(spark, 3)
    assert z.shape == (3, 1) and z.length == 3 and z.element(2) == 1.0
    assert build.randn(spark, 4, 4, seed=1).collect().tolist() == build.randn(spark, 4, 4, seed=1).collect().tolist()
    assert build.zeros(spark, 2).clear().kind == "N"
    with pytest.raises(InvalidArgumentError):
        build.resize(build.zeros(spark, 3, 3), 2, 3)
    with pytest.raises(StateError):
        build.init(build.zeros(spark, 2, 2), [1.0])
    with pytest.raises(IndexRangeError):
        z.element(7)


def test_products(spark, a, rng):
    b = rng.normal(size=(6, 4))
    for mode in ("exact", "fast", "block"):
        assert np.allclose(product.matmul(of(spark, a), of(spark, b), mode).collect(), a @ b)
    assert np.allclose(product.gram(of(spark, b)).collect(), b.T @ b)
    assert np.allclose(product.matmul(of(spark, [[2.0]]), of(spark, a)).collect(), 2 * a)
    assert np.allclose(product.outer(of(spark, b[:, :1]), of(spark, b[:1])).collect(), b[:, :1] @ b[:1])
    with pytest.raises(DimensionError):
        product.matmul(of(spark, b), of(spark, a))
    with pytest.raises(DimensionError):
        elementwise.add(of(spark, a), of(spark, b))


def test_exact_product_ignores_partitioning(spark, a):
    x = of(spark, a)
    y = Matrix(x.df.repartition(7), 6, 6)
    assert product.matmul(x, x).collect().tolist() == product.matmul(y, y).collect().tolist()


def test_submatrix_selectors(spark):
    x = np.arange(225.0).reshape(15, 15)
    m = of(spark, x)
    for rows, cols in (((), ()), ((3,), ()), ((), (4,)), ((2, 7), (1, 5)), ((0, 3, 14), (2, 2, 9)), ((5, 5), (14,))):
        def cut(s):
            return slice(None) if not s else slice(s[0], s[0] + 1) if len(s) == 1 else slice(s[0], s[1] + 1) if len(s) == 2 else slice(s[0], s[2] + 1, s[1])
        assert np.array_equal(reshape.submatrix(m, rows, cols).collect(), x[cut(rows), cut(cols)])
    for bad in ((15,), (-1, 2), (3, 2), (0, 0, 5)):
        with pytest.raises(IndexRangeError):
            reshape.submatrix(m, bad)


def test_solvers(spark, a, rng):
    s, spd, b = a + a.T, a @ a.T + np.eye(6), rng.normal(size=(6, 2))
    spd = (spd + spd.T) / 2
    assert np.allclose(solve.solve(of(spark, a), of(spark, b)).collect(), np.linalg.solve(a, b))
    assert np.allclose(solve.inverse(of(spark, a)).collect() @ a, np.eye(6))
    low, up, order = (m.collect() for m in solve.lu_factors(of(spark, a)))
    assert np.allclose(a[order[:, 0].astype(int)], low @ up)
    u = solve.cholesky(of(spark, spd)).collect()
    assert np.allclose(u.T @ u, spd) and np.allclose(u, np.triu(u))
    q, r = (m.collect() for m in solve.qr(of(spark, b)))
    assert np.allclose(q @ r, b) and np.allclose(q.T @ q, np.eye(6))
    h, q = (m.collect() for m in solve.hessenberg(of(spark, a)))
    assert np.allclose(q @ h @ q.T, a) and np.allclose(np.tril(h, -2), 0)
    q2, r2 = (m.collect() for m in solve.qr_hessenberg(of(spark, h)))
    assert np.allclose(q2 @ r2, h)
    t, q = (m.collect() for m in solve.tridiagonal(of(spark, s)))
    assert np.allclose(q @ t @ q.T, s) and np.allclose(np.triu(t, 2), 0)
    q3, r3 = (m.collect() for m in solve.qr_tridiagonal(of(spark, t)))
    assert np.allclose(q3 @ r3, t)
    e, v = (m.collect() for m in solve.eigsym_vectors(of(spark, s)))
    assert np.allclose(s @ v, v @ e)
    e, v = (m.collect() for m in solve.eigsymge(of(spark, s), of(spark, spd)))
    assert np.allclose(s @ v, spd @ v @ e)
    assert np.allclose(solve.conjugate_gradient(of(spark, spd), of(spark, b[:, :1])).collect(), np.linalg.solve(spd, b[:, :1]))
    for bad in (lambda: solve.cholesky(of(spark, a)), lambda: solve.cholesky(of(spark, -spd)), lambda: solve.eigsym(of(spark, a)), lambda: solve.inverse(of(spark, np.zeros((2, 2))))):
        with pytest.raises(Exception, match="symmetric|positive|ingular"):
            bad().collect()


def test_errors():
    assert issubclass(VerificationError, NumericalError) and issubclass(LapackError, MatrixError)
    assert LapackError("dgesv", 3).info == 3
    with pytest.raises(DomainError, match="p = 3"):
        throw(DomainError, "p = ", 3)
    assert is_interval("interval") and not is_ordered("poly") and is_poly("poly")


def test_enclosures_hold_exact_results(spark, rng):
    x, y = rng.normal(size=500) * 10.0 ** rng.integers(-150, 150, 500), rng.normal(size=500)
    special = [(1 / 3, 3.0), (2.0**-27, 1 + 2.0**-27), (0.0, 5.0), (-1 / 3, 1 / 3), (5e-324, 0.5), (1e308, 1e-10)]
    rows = [*zip(x.tolist(), y.tolist(), strict=True), *special]
    d = spark.createDataFrame(rows, "x double, y double")
    p, q = (F.col("x"), F.col("x")), (F.col("y"), F.col("y"))
    ops = {"add": (X.i_add(p, q), lambda s, t: s + t), "sub": (X.i_sub(p, q), lambda s, t: s - t), "mul": (X.i_mul(p, q), lambda s, t: s * t), "cube": (X.i_pow(p, 1), lambda s, t: s)}
    d = d.select("x", "y", *[c.alias(f"{n}{k}") for n, (v, _) in ops.items() for k, c in enumerate(v)])
    for r in d.collect():
        for n, (_, f) in ops.items():
            z = f(Fraction(r["x"]), Fraction(r["y"]))
            lo, hi = r[f"{n}0"], r[f"{n}1"]
            assert lo <= hi and (math.isinf(lo) or Fraction(lo) <= z) and (math.isinf(hi) or z <= Fraction(hi))


def test_two_sum_and_two_prod_are_exact(spark, rng):
    x, y = (rng.normal(size=300) * 10.0 ** rng.integers(-80, 80, 300) for _ in range(2))
    d = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True)], "x double, y double")
    s, p = X.two_sum(F.col("x"), F.col("y")), X.two_prod(F.col("x"), F.col("y"))
    for r in d.select("x", "y", s[0].alias("s"), s[1].alias("e"), p[0].alias("p"), p[1].alias("f")).collect():
        assert Fraction(r["s"]) + Fraction(r["e"]) == Fraction(r["x"]) + Fraction(r["y"])
        assert Fraction(r["p"]) + Fraction(r["f"]) == Fraction(r["x"]) * Fraction(r["y"])


def test_functions_of_intervals(spark, rng):
    lo = rng.uniform(-10, 10, 200)
    hi = lo + rng.uniform(0, 7, 200)
    d = spark.createDataFrame([*zip(lo.tolist(), hi.tolist(), strict=True)], "lo double, hi double")
    v = (F.col("lo"), F.col("hi"))
    fs = {"sin": (X.i_sin(v), np.sin), "cos": (X.i_cos(v), np.cos), "exp": (X.i_exp(v), np.exp), "sq": (X.i_pow(v, 2), np.square), "cube": (X.i_pow(v, 3), lambda t: t**3), "abs": (X.i_abs(v), np.abs)}
    for r in d.select("lo", "hi", *[c.alias(f"{n}{k}") for n, (e, _) in fs.items() for k, c in enumerate(e)]).collect():
        t = np.linspace(r["lo"], r["hi"], 400)
        for n, (_, f) in fs.items():
            z = f(t)
            slack = 1e-12 * (1 + np.abs(z).max())
            assert r[f"{n}0"] <= z.min() and z.max() <= r[f"{n}1"], n
            if n not in ("cube",):
                assert r[f"{n}1"] - z.max() < 1e-2 * (1 + np.abs(z).max()) + slack


def exact_product(x, y):
    return [[sum(Fraction(p) * Fraction(q) for p, q in zip(r, c, strict=True)) for c in zip(*y, strict=True)] for r in x]


@pytest.mark.parametrize("f", [product.directed_pair, lambda a, b: product.verified_product(a, b), lambda a, b: product.verified_product(a, b, "fast"), lambda a, b: product.mid_rad_product(red.interval(a), red.interval(b)), lambda a, b: product.fma_product(red.interval(a), red.interval(b))])
def test_products_enclose(spark, rng, f):
    n = 5
    third, small = np.zeros((n, n)), np.zeros((n, n))
    third[:, 1] = third[1] = 1 / 3
    small[:, 0], small[:, 1] = 1, 2.0**-27
    for x, y in ((third, third.T), (small, small.T), (rng.normal(size=(n, n)), rng.normal(size=(n, n)))):
        z, want = f(of(spark, x), of(spark, y)).collect(), exact_product(x.tolist(), y.tolist())
        for i in range(n):
            for j in range(n):
                assert Fraction(z[i, j, 0]) <= want[i][j] <= Fraction(z[i, j, 1])
    assert (product.directed_product(of(spark, third), of(spark, third), 1).collect() > product.directed_product(of(spark, third), of(spark, third), -1).collect()).any()


def test_verified_solve_and_eigenvalues(spark, a):
    n = 4
    x = a[:n, :n] + 4 * np.eye(n)
    b = np.ones((n, 1))
    z = verify.verified_solve(of(spark, x), of(spark, b)).collect()
    exact = [Fraction(v) for v in np.linalg.solve(x, b)[:, 0]]
    rest = [sum(Fraction(x[i, j]) * exact[j] for j in range(n)) - 1 for i in range(n)]
    assert max(abs(float(r)) for r in rest) < 1e-13
    assert all(z[i, 0, 0] <= float(exact[i]) <= z[i, 0, 1] and z[i, 0, 1] - z[i, 0, 0] < 1e-12 for i in range(n))
    s = np.diag([1.0, 2.0, 3.0, 5.0])
    e = verify.verified_eigsym(elementwise.convert(of(spark, s), "interval")).collect()
    assert all(e[i, i, 0] <= v <= e[i, i, 1] for i, v in enumerate((1.0, 2.0, 3.0, 5.0)))
    with pytest.raises(Exception, match="verification|ingular"):
        verify.verified_solve(Matrix(of(spark, [[1, 1], [1, 1 + 1e-3]]).df.select("i", "j", (F.col("v") - 0.1).alias("lo"), (F.col("v") + 0.1).alias("hi")), 2, 2, "interval"), of(spark, [[1], [1]])).collect()


def test_overlapping_intervals_merge(spark):
    d = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.5, 3.0), (2, 2.9, 4.0), (3, 5.0, 6.0)], "i int, lo double, hi double")
    assert {r["i"]: (r["lo"], r["hi"]) for r in verify.merged(d, (), "i").collect()} == {0: (1.0, 4.0), 1: (1.0, 4.0), 2: (1.0, 4.0), 3: (5.0, 6.0)}


def test_krawczyk(spark):
    """x^2 = 2 from 1.4142."""
    x0 = 1.4142
    residual = Matrix(spark.createDataFrame([(0, 0, x0 * x0 - 2 - 1e-15, x0 * x0 - 2 + 1e-15)], "i int, j int, lo double, hi double"), 1, 1, "interval")
    start = Matrix(spark.createDataFrame([(0, 0, -1e-3, 1e-3)], "i int, j int, lo double, hi double"), 1, 1, "interval")
    box = verify.krawczyk(of(spark, [[1 / (2 * x0)]]), residual, lambda k: elementwise.scale(2.0, elementwise.add(k, x0)), start).collect()
    assert x0 + box[0, 0, 0] <= math.sqrt(2) <= x0 + box[0, 0, 1]


def test_double_double(spark, rng):
    x = rng.normal(size=(4, 4))
    z = product.matmul(elementwise.convert(of(spark, x), "dd"), elementwise.convert(of(spark, x), "dd")).collect()
    want = exact_product(x.tolist(), x.tolist())
    for i in range(4):
        for j in range(4):
            assert abs(Fraction(z[i, j, 0]) + Fraction(z[i, j, 1]) - want[i][j]) <= Fraction(1, 10**29)
    q = elementwise.divide(elementwise.convert(of(spark, [[1.0]]), "dd"), 3.0).collect()[0, 0]
    assert abs(Fraction(q[0]) + Fraction(q[1]) - Fraction(1, 3)) < Fraction(1, 10**31)


def test_conversions(spark):
    m = of(spark, [[0.1, -2.5]])
    for chain in (("dd", "double"), ("interval", "double"), ("interval_dd", "interval"), ("dd", "interval"), ("dd", "interval_dd")):
        out = m
        for e in chain:
            out = elementwise.convert(out, e)
        got = out.collect()
        assert np.allclose(got if got.ndim == 2 else got[..., 0], [[0.1, -2.5]])
    with pytest.raises(InvalidArgumentError):
        elementwise.convert(m, "bool")


def test_legendre(spark):
    for n in (2, 5, 20):
        g = legendre.gauss_legendre(n)
        want = np.polynomial.legendre.leggauss(n)
        assert np.allclose([float(x[0]) for x in g], want[0], atol=1e-15) and np.allclose([float(x[2]) for x in g], want[1], atol=1e-14)
        assert all(lo <= hi and w1 <= w2 for lo, hi, w1, w2 in g)
    assert legendre.quadrature_order(20, 2, 1) == 36 and legendre.quadrature_order(20, 2, 5) == 50 and legendre.quadrature_order(20, 2, 2) == 46
    b = legendre.Basis(spark, 6, 2, 1, mode=1)
    assert np.allclose(b.set_uh().weighted_mass(0).collect(), b.mass().collect(), atol=1e-14)
    e = solve.eigsymge(b.mass(), b.stiffness())[0].collect().diagonal()
    assert abs(1 / e.max() - math.pi**2) < 1e-4  # the first eigenvalue of the Laplacian
    with pytest.raises(InvalidArgumentError):
        legendre.quadrature_order(1, 2, 1)
    with pytest.raises(DomainError):
        legendre.sobolev_constant(spark, 2, 2.0)
    lo, hi = legendre.global_maximum(spark, lambda x: X.i_mul(x[0], X.i_sub((F.lit(1.0), F.lit(1.0)), x[0])), [(0.0, 1.0)], 2.0**-8)
    assert hi <= 0.25 <= lo and lo - hi < 0.01


def test_polynomials(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "c array<double>")
    r = d.select(X.poly_shift(F.col("c"), F.lit(2.0)).alias("s"), X.poly_mul(F.col("c"), F.array(F.lit(1.0), F.lit(1.0))).alias("m"), X.poly_diff(F.col("c")).alias("d"), F.struct(*[x.alias(n) for x, n in zip(X.i_horner(F.col("c"), (F.lit(0.9), F.lit(1.1))), "ab", strict=True)]).alias("i")).first()
    p = np.polynomial.Polynomial([1, 2, 3, 4])
    assert np.allclose(r["s"], p(np.polynomial.Polynomial([2, 1])).coef)
    assert np.allclose(r["m"], (p * np.polynomial.Polynomial([1, 1])).coef) and np.allclose(r["d"], p.deriv().coef)
    assert r["i"]["a"] <= p(0.9) and p(1.1) <= r["i"]["b"]
    one = build.ones(spark, 2, 2, "poly")
    assert list(product.matmul(one, one, "exact").element(0, 0))[0] == 2.0


def test_fourier(spark):
    s = fourier.series(spark, 1.0, [(1.0, 0.5), (0.0, 2.0)])
    u = fourier.series(spark, -0.5, [(0.25, 1.0)])
    t = 0.37

    def at(x):
        return x.value(t).first()[0]

    assert abs(at(s * u) - at(s) * at(u)) < 1e-12
    assert abs(at(s.mul_sin(3)) - at(s) * math.sin(3 * t)) < 1e-12 and abs(at(s.mul_cos(1)) - at(s) * math.cos(t)) < 1e-12
    assert abs(at(s.delay(0.2)) - s.value(t + 0.2).first()[0]) < 1e-12
    h = 1e-6
    assert abs(at(s.diff()) - (s.value(t + h).first()[0] - s.value(t - h).first()[0]) / (2 * h)) < 1e-6
    assert s.norm_inf(400).first()[0] >= max(abs(r["value"]) for r in s.sampled(0, 6.28, 0.01).collect())
    assert s.with_sin(2, 9.0).sin(2) == 9.0 and s.with_a0(3.0).a0() == 3.0 and (s - s).norm_l2().first()[0] == 0
    q = fourier.Quadrature(spark, 2, 64)
    v = q.vector(q.sampled(lambda x: 1.0 + F.sin(x) + 0.5 * F.cos(x) + 2 * F.cos(2 * x))).collect()[:, 0]
    assert np.allclose(v, [1.0, 1.0, 0.5, 0.0, 2.0])
    assert s.display().first()[0].startswith("1.0 + 1.0 sin(1t)")
    with pytest.raises(InvalidArgumentError):
        s.mul_sin(0)


def test_fourier_assembly_matches_differences(spark):
    s = fourier.series(spark, 0.3, [(1.0, 0.5), (0.2, -0.4)])
    a = fourier.Assembly(spark, 2)
    a.add_series(s)
    a.add_derivative()
    a.add_scalar(2.0, 0.3)
    j = a.jacobian().collect()
    for k in range(5):
        unit = np.zeros((5, 1))
        unit[k] = 1
        x, _ = a.to_series(of(spark, unit))
        want = a.to_vector((s * x + x.diff() + x.delay(0.3) * 2.0).projection(2)).collect()[:, 0]
        assert np.allclose(j[:, k], want), k
    b = fourier.Assembly(spark, 2, omit=(1,))
    b.add_scalar(1.0)
    b.add_iota(s)
    assert np.allclose(b.jacobian().collect()[:, 1], b.to_vector(s).collect()[:, 0])
    with pytest.raises(StateError):
        fourier.Assembly(spark, 2, "odd").add_derivative()


def test_cosine_basis(spark):
    s = fourier.series(spark, 0.5, [(0.0, 1.0), (0.0, -2.0)])
    b = fourier.CosineBasis(spark, 2)
    j = b.jacobian(s).collect()
    assert np.allclose(j[:, 0], b.load(s / 2.0).collect()[:, 0]) and np.allclose(j[:, 1], b.load(s.mul_cos(1)).collect()[:, 0])


def test_newton_and_runge_kutta(spark):
    n = Newton(lambda x: x.like(x.df.withColumn("v", F.col("v") * F.col("v") - 2)), lambda x: elementwise.scale(2.0, x))
    assert abs(n.solve(of(spark, [[1.4]])).element(0, 0) - math.sqrt(2)) < 1e-15 and n.converged
    a, b, c = tableau(3)
    assert len(b) == 4 and abs(sum(b) - 1) < 1e-15 and all(abs(sum(r) - x) < 1e-14 for r, x in zip(a, c, strict=True))
    run = ImplicitRungeKutta(lambda t, x: np.array([x[1], -x[0]]), lambda t, x: np.array([[0.0, 1.0], [-1.0, 0.0]]), 4, 0.25, 0.0, 1.0)
    d = run.solve(spark.createDataFrame([(5, 1.0, 0.0)], "k long, x double, y double"), "k", ["x", "y"])
    end = {r["comp"]: r["x"] for r in d.where("t > 0.999").collect()}
    assert abs(end[0] - math.cos(1)) < 1e-12 and abs(end[1] + math.sin(1)) < 1e-12
    t = Timer()
    t.tic()
    assert t.toc() >= 0


@pytest.mark.parametrize("elem", list(mf.TYPES))
@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (3, 1), (3, 4)])
def test_files(spark, tmp_path, elem, shape):
    rng = np.random.default_rng(1)
    k = len(mf.VALUES[elem])
    x = rng.integers(-5, 5, (*shape, k)) if elem == "int" else rng.normal(size=(*shape, k))
    for kind, path in (("portable", tmp_path / "m"), ("legacy", tmp_path / f"m{mf.ENDINGS[elem]}")):
        path.write_bytes((mf.portable if kind == "portable" else mf.legacy)(x, elem))
        got = mf.load(spark, tmp_path / "m", elem, kind)
        assert got.shape == shape and np.array_equal(got.collect().reshape(*shape, k), x)


def test_file_writer_and_checks(spark, tmp_path):
    m = of(spark, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    mf.save(m, tmp_path / "a")
    mf.save(m, tmp_path / "a", "legacy")
    assert (tmp_path / "a").read_bytes() == mf.portable(m.collect()[..., None], "double")
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.endswith("tmp")) == []
    good = (tmp_path / "a").read_bytes()
    for at, what in ((0, "magic"), (8, "version"), (12, "type"), (16, "layout"), (20, "reserved"), (24, "size"), (50, "checksum")):
        bad = bytearray(good)
        bad[at] ^= 0x40
        (tmp_path / "b").write_bytes(bad)
        with pytest.raises(FileError, match=what):
            mf.load(spark, tmp_path / "b")
    for data in (good + b"x", good[:-1], b""):
        (tmp_path / "b").write_bytes(data)
        with pytest.raises(FileError):
            mf.load(spark, tmp_path / "b")
    with pytest.raises(FileError):
        mf.load(spark, tmp_path / "a", "int")
    assert mf.crc64(b"") == 0 and mf.crc64(b"123456789") == 0x6C40DF5F0B497347


def test_checksums_of_stripes_join(monkeypatch, tmp_path, spark):
    def slow(data, crc=0):
        for b in data:
            crc = ((crc << 8) & (1 << 64) - 1) ^ mf._CRC[(crc >> 56) ^ b]
        return crc

    rng = np.random.default_rng(3)
    for n in (0, 1, 4095, 4 * 4096 - 1, 4 * 4096, 4 * 4096 + 7, 100_003):
        x = rng.bytes(n)
        assert mf.crc64(x) == slow(x)
        assert mf.joined(slow(x[: n // 3]), slow(x[n // 3 :]), n - n // 3) == slow(x)
    monkeypatch.setattr(mf, "STRIPE", 1000)
    x = rng.normal(size=(70, 9, 1))
    (tmp_path / "m").write_bytes(mf.portable(x, "double"))
    assert mf.verified(str(tmp_path / "m"), spark) == mf.verified(str(tmp_path / "m"))
    bad = bytearray((tmp_path / "m").read_bytes())
    bad[3333] ^= 1
    (tmp_path / "m").write_bytes(bad)
    with pytest.raises(FileError, match="checksum"):
        mf.verified(str(tmp_path / "m"), spark)


def test_files_refuse_elements_outside(spark, tmp_path):
    mf.register(spark)
    d = spark.createDataFrame([(0, 0, 1.0), (0, 5, 2.0)], "i int, j int, v double")
    with pytest.raises(Exception, match="outside"):
        d.write.format("matbin").option("elem", "double").option("rows", 1).option("cols", 2).mode("overwrite").save(str(tmp_path / "x"))
    assert list(tmp_path.iterdir()) == []


def test_long_sums_are_bounded(spark, monkeypatch):
    """Beyond ORDERED terms nothing gathers a whole line: plain sums, ranges of directed sums, ranges of double-double sums."""
    monkeypatch.setattr(red, "ORDERED", 8)
    monkeypatch.setattr(product, "ORDERED", 8)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3, 30)), rng.normal(size=(30, 2))
    a, b = of(spark, x), of(spark, y)
    assert np.allclose(product.matmul(a, b).collect(), x @ y, rtol=1e-12)
    assert np.allclose(red.total(of(spark, y)).collect(), y.sum(0), rtol=1e-12)
    exact = [[sum(Fraction(x[i, k]) * Fraction(y[k, j]) for k in range(30)) for j in range(2)] for i in range(3)]
    pairs = [product.directed_pair(a, b).collect(), product.fma_product(red.interval(a), red.interval(b)).collect(), product.matmul(red.interval(a), red.interval(b)).collect()]
    for p in pairs:
        assert all(Fraction(p[i, j, 0]) <= exact[i][j] <= Fraction(p[i, j, 1]) for i in range(3) for j in range(2))
        assert (p[..., 1] - p[..., 0]).max() < 1e-12
    for m, want in ((of(spark, x[:1]), x[0]), (of(spark, y[:, :1]), y[:, 0])):
        hi, lo = red.total(elementwise.convert(m, "dd")).collect()[0, 0]
        assert abs(Fraction(hi) + Fraction(lo) - sum(map(Fraction, want))) < Fraction(1, 10**28)


def test_small_systems_are_stacked(spark, monkeypatch):
    """Many systems in Arrow batches give what a group for each gives."""
    rng = np.random.default_rng(8)
    rows = [(f"k{g}", i, j, float(v)) for g in range(25) for (i, j), v in np.ndenumerate(rng.normal(size=(3, 3)) + 4 * np.eye(3))]
    a = Matrix(spark.createDataFrame(rows, "g string, i int, j int, v double"), 3, 3, by=("g",))
    b = Matrix(a.df.where("j = 0"), 3, 1, by=("g",))
    read = lambda: [sorted(map(tuple, m.df.collect())) for m in (solve.solve(a, b), *solve.lu(a))]
    stacked = read()
    monkeypatch.setattr(solve, "ROW", 0)
    assert stacked == read()
    assert all(abs(v - (i == 0)) < 1e-12 for _, i, _, v in stacked[0])


def test_grid_query_counts_its_nodes(spark, monkeypatch):
    from enclosa.operators import legendre
    from enclosa.plans import queries

    assert queries.h09_grid(spark, "").first()["nodes"] == 36  # six on an axis
    grid = legendre.Basis.grid
    monkeypatch.setattr(legendre.Basis, "grid", lambda self: grid(self).where("q > 0"))
    assert queries.h09_grid(spark, "").first()["nodes"] == 35


def _exact_gram(lo, hi, other_lo, other_hi, square=False):
    """Ends of the exact product of interval matrices, as fractions."""
    low, high = {}, {}
    for i in range(lo.shape[0]):
        for j in range(other_lo.shape[1]):
            p, q = [], []
            for k in range(lo.shape[1]):
                c = [Fraction(u) * Fraction(v) for u in (lo[i, k], hi[i, k]) for v in (other_lo[k, j], other_hi[k, j])]
                if square and i == j:
                    c = [c[0], c[3]] + ([Fraction(0)] if lo[i, k] <= 0 <= hi[i, k] else [])
                p.append(min(c))
                q.append(max(c))
            low[i, j], high[i, j] = sum(p), sum(q)
    return low, high


@pytest.fixture(scope="module")
def long_intervals(spark, rng):
    """3 x 1300, with elements of many bits: (matrix, its transpose, lo, hi)."""
    mid = rng.normal(size=(3, 1300)) * 10 + 3
    lo, hi = mid - 0.1, mid + 0.3
    rows = [(i, j, float(lo[i, j]), float(hi[i, j])) for i in range(3) for j in range(1300)]
    m = Matrix(spark.createDataFrame(rows, "i int, j int, lo double, hi double"), 3, 1300, "interval")
    return m, reshape.transpose(m), lo, hi


def _tight(found: Matrix, low, high, width: float, shape=(3, 3)):
    rows = {(r.i, r.j): r for r in found.df.collect()}
    assert len(rows) == shape[0] * shape[1]
    for at, r in rows.items():
        assert Fraction(r.lo) <= low[at] and Fraction(r.hi) >= high[at]
        assert low[at] - Fraction(r.lo) <= Fraction(width) and Fraction(r.hi) - high[at] <= Fraction(width)


def test_tile_sums_move_no_terms(spark, long_intervals):
    m, t, lo, hi = long_intervals
    low, high = _exact_gram(lo, hi, lo.T, hi.T)
    d = product.tile_sums(m, t)
    for r in d.collect():
        for got, want in ((r.low, low), (r.high, high)):
            assert abs(Fraction(got.hi) + Fraction(got.lo) - want[r.i, r.j]) <= Fraction(2) ** -80
    assert product.tiled(m)


def test_mid_rad_product_of_many_terms(spark, long_intervals):
    """No wider by rounding than 1e-10; plain sums of 1300 terms bounded beforehand gave some 1e-7."""
    m, t, lo, hi = long_intervals
    rows = {(r.i, r.j): r for r in product.mid_rad_product(m, t).df.collect()}
    low, high = _exact_gram(lo, hi, lo.T, hi.T)
    mid = lambda i, k: Fraction(float(lo[i, k] + (hi[i, k] - lo[i, k]) / 2))
    rad = lambda i, k: max(Fraction(hi[i, k]) - mid(i, k), mid(i, k) - Fraction(lo[i, k]))
    for (i, j), r in rows.items():
        c = sum(mid(i, k) * mid(j, k) for k in range(1300))
        s = sum((abs(mid(i, k)) + rad(i, k)) * rad(j, k) + rad(i, k) * abs(mid(j, k)) for k in range(1300))
        assert Fraction(r.lo) <= low[i, j] and Fraction(r.hi) >= high[i, j]
        assert abs(Fraction(r.lo) - (c - s)) <= Fraction(1e-10) and abs(Fraction(r.hi) - (c + s)) <= Fraction(1e-10)


def test_fma_product_of_many_terms(spark, long_intervals):
    """Narrower than one rounding a step makes it, as the terms are not gathered in order."""
    m, t, lo, hi = long_intervals
    _tight(product.fma_product(m, t), *_exact_gram(lo, hi, lo.T, hi.T), 1e-10)


def test_interval_gram_of_many_terms(spark, long_intervals):
    m, t, lo, hi = long_intervals
    _tight(product.gram(t), *_exact_gram(lo, hi, lo.T, hi.T, square=True), 1e-10)


def test_mixed_product_of_many_terms(spark, long_intervals):
    """Plain sums widened the ends by their number times rounding of all magnitudes."""
    m, t, lo, hi = long_intervals
    p = elementwise.mapped(t, lambda x: (x[0],), "double")
    _tight(product.mixed_product(m, p, "fast"), *_exact_gram(lo, hi, lo.T, lo.T), 1e-10)


def test_point_times_interval_of_many_terms(spark, long_intervals):
    m, t, lo, hi = long_intervals
    p = elementwise.mapped(m, lambda x: (x[0],), "double")
    _tight(product.mixed_product(p, t, "fast"), *_exact_gram(lo, lo, lo.T, hi.T), 1e-10)


def test_verified_gram_of_many_terms(spark, long_intervals):
    m, t, lo, hi = long_intervals
    p = elementwise.mapped(t, lambda x: (x[0],), "double")
    _tight(product.verified_gram(p), *_exact_gram(lo, lo, lo.T, lo.T, square=True), 1e-10)


def test_fast_verified_gram_of_many_terms(spark, long_intervals):
    m, t, lo, hi = long_intervals
    p = elementwise.mapped(t, lambda x: (x[0],), "double")
    _tight(red.symmetrised(product.verified_gram(p, "fast")), *_exact_gram(lo, lo, lo.T, lo.T, square=True), 1e-10)


def test_outer_gathers_nothing(spark, rng):
    """No grouping of its n * n elements, and not all rows of both in the one task of their inner index."""
    x, y = rng.normal(size=(40, 1)), rng.normal(size=(1, 30))
    d = product.outer(of(spark, x), of(spark, y))
    assert np.array_equal(d.collect(), x @ y) and d.shape == (40, 30)
    plan = d.df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan
    whole = elementwise.mapped(of(spark, [[2.0], [3.0]]), lambda v: (v[0].cast("int"),), "int")
    assert product.outer(whole, reshape.transpose(whole)).df.count() == 4


def test_solver_queries_keep_their_system(spark, tmp_path):
    """The system's sums, which depend in their last bits on the order of adding, are made once: the residual is of what was solved."""
    from enclosa.plans import queries

    rows = [(float(k % 50 + 1), 0.1 * k + 0.01) for k in range(300)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for m in queries._one_system(spark, str(tmp_path), "dd"):
        assert "lineitem.parquet" not in m.df._jdf.queryExecution().toString()


def test_hybrid_solve_keeps_its_system(spark, tmp_path):
    """The residual that decides ``precise`` is of the sums that were solved, not of sums made again in another order."""
    from enclosa.plans import queries

    rows = [(float(k % 50 + 1), 0.1 * k + 0.01) for k in range(300)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = queries.f07_hybrid_solve(spark, str(tmp_path))
    assert d.inputFiles() == []
    assert {(r.i, r.precise) for r in d.collect()} == {(0, True), (1, True)}


@pytest.fixture(scope="module")
def cancelling_vectors(spark, tmp_path_factory):
    """1301 embeddings whose first two columns have great terms and a small product, just above the middle of two numbers of five digits."""
    folder = str(tmp_path_factory.mktemp("cancelling"))
    first = [2.0**19, -(2.0**19)] * 650 + [5.00002e-6]
    rows = [(k, [v, 1.0] + [0.0] * 62) for k, v in enumerate(first)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def _row(d, i, j):
    r = d.where((F.col("i") == i) & (F.col("j") == j)).first()
    return r.lo, r.hi, r.holds, r.narrow


def test_point_interval_query_rounds_as_the_exact_product(spark, cancelling_vectors):
    """A bound of plain sums takes the lower end over the middle, to the next number of five digits."""
    from enclosa.plans import queries

    assert _row(queries.d14_point_interval(spark, cancelling_vectors), 0, 1) == (-162.62499, 162.62501, True, True)


def test_verified_gram_query_rounds_as_the_exact_product(spark, cancelling_vectors):
    from enclosa.plans import queries

    assert _row(queries.d12_verified_gram(spark, cancelling_vectors), 0, 1) == (1e-05, 1e-05, True, True)


def test_exact_totals(spark, rng):
    """Sums to double-double accuracy of numbers that cancel, with nulls and an empty column, for any partitioning."""
    v = [*(rng.normal(size=400) * 10.0 ** rng.integers(-8, 9, size=400)).tolist(), None]
    v = [*v, *(-x for x in v[:390])]
    d = spark.createDataFrame([(x, None) for x in v], "v double, none double")
    exact = sum(Fraction(x) for x in v if x is not None)
    for n in (1, 7):
        r = red.exact_totals(d.repartition(n), {"v": (F.col("v"),), "vv": X.two_prod(F.col("v"), F.col("v")), "none": (F.col("none"),)}).first()
        assert r.v.hi == float(exact) and abs(Fraction(r.v.hi) + Fraction(r.v.lo) - exact) < abs(exact) * Fraction(2) ** -80
        assert r.vv.hi == float(sum(Fraction(x) ** 2 for x in v if x is not None)) and r.none is None


def test_double_double_product_rounds_no_slice(spark):
    """Two terms whose slices' products need 54 bits together."""
    x = [[1 - 2.0**-20, 2.0**-27 - 2.0**-11], [3.0, -0.1]]
    a = elementwise.convert(of(spark, x), "dd")
    for r in product.dd_product(a, reshape.transpose(a)).df.collect():
        exact = sum(Fraction(u) * Fraction(v) for u, v in zip(x[r.i], x[r.j], strict=True))
        assert abs(Fraction(r.hi) + Fraction(r.lo) - exact) <= abs(exact) * Fraction(2) ** -100


def test_refined_eigenpairs_query_sums_without_rounding(spark, tmp_path):
    """Plain sums of quantities that are not whole are off in the digits that the query returns; and these pairs are precise only if no slice's product is rounded."""
    from enclosa.plans import queries

    q = [123.456789 + 0.1 * k for k in range(20000)]
    spark.createDataFrame([(x, 1.0) for x in q], "l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    n, x, xx = len(q), sum(map(Fraction, q)), sum(Fraction(v) ** 2 for v in q)
    with localcontext() as c:
        c.prec = 60
        n, x, xx = (Decimal(v.numerator) / v.denominator for v in (Fraction(n), x, xx))
        root = ((n - xx) ** 2 / 4 + x * x).sqrt()
        ends = [round(float((n + xx) / 2 + s * root), 3) for s in (-1, 1)]
    got = sorted(queries.f17_refined_eigenpairs(spark, str(tmp_path)).collect())
    assert [(r.v, r.precise) for r in got] == [(e, True) for e in ends]
