"""Column arithmetic: IEEE division and logarithm, outward rounding, error-free sums and products.

Everything is a Column of built-in functions and runs in the JVM.  Directed
rounding is replaced by the bounds of Rump, Zimmermann, Boldo and Melquiond
(BIT 2009): for a result c rounded to nearest, the exact one lies within
PHI * |c| + ETA of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PHI = 1.1102230246251568e-16
ETA = 5e-324
INF = float("inf")
SPLIT = 134217729.0


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with the infinities and NaN of IEEE arithmetic where b is 0."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b))


def ieee_ln(v: Column) -> Column:
    return F.when(v == 0, F.lit(-INF)).when(v < 0, F.lit(float("nan"))).otherwise(F.ln(v))


def up(c: Column) -> Column:
    return c + (F.abs(c) * PHI + F.lit(ETA))


def dn(c: Column) -> Column:
    return c - (F.abs(c) * PHI + F.lit(ETA))


def int_pow(v: Column, n: int) -> Column:
    """v**n as a product from the left, the same in every engine."""
    if n < 0:
        return ieee_div(F.lit(1.0), int_pow(v, -n))
    out = F.lit(1.0) if n == 0 else v
    for _ in range(n - 1):
        out = out * v
    return out


def two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """As two_sum, where |a| >= |b|."""
    s = a + b
    return s, b - (s - a)


def two_prod(a: Column, b: Column) -> tuple[Column, Column]:
    """The rounded product and its exact error, for factors below about 1e300 (Dekker)."""
    p = a * b
    ca, cb = a * SPLIT, b * SPLIT
    ah, bh = ca - (ca - a), cb - (cb - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


Pair = tuple[Column, Column]


def _pair(s: Column, first: str, second: str) -> Pair:
    return s[first], s[second]


# --- double-double: (hi, lo) -------------------------------------------------


def _dd(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def _renormalised(hi: Column, lo: Column) -> Column:
    return let(_dd(hi, lo), lambda x: _dd(*quick_two_sum(x["hi"], x["lo"])))


def dd_add(a: Pair, b: Pair) -> Column:
    """A struct (hi, lo)."""
    high, low = two_sum(a[0], b[0]), two_sum(a[1], b[1])
    x = F.struct(high[0].alias("s"), high[1].alias("e"), low[0].alias("t"), low[1].alias("f"))
    return let(x, lambda x: let(_renormalised(x["s"], x["e"] + x["t"]), lambda y: _renormalised(y["hi"], y["lo"] + x["f"])))


def dd_neg(a: Pair) -> Pair:
    return -a[0], -a[1]


def dd_mul(a: Pair, b: Pair) -> Column:
    p, e = two_prod(a[0], b[0])
    return let(_dd(p, e), lambda x: _renormalised(x["hi"], x["lo"] + (a[0] * b[1] + a[1] * b[0])))


def dd_div(a: Pair, b: Pair) -> Column:
    """Two Newton corrections of the rounded quotient."""
    q = ieee_div(a[0], b[0])

    def better(q: Pair) -> Column:
        rest = let(dd_mul(q, b), lambda p: dd_add(a, (-p["hi"], -p["lo"])))
        return let(rest, lambda r: dd_add(q, (ieee_div(r["hi"], b[0]), F.lit(0.0))))

    return let(let(_dd(q, F.lit(0.0)), lambda x: better(_pair(x, "hi", "lo"))), lambda x: better(_pair(x, "hi", "lo")))


def dd_sum(items: Column) -> Column:
    """A struct (hi, lo): the sum of an array of structs (hi, lo), in order."""
    return F.aggregate(items, _dd(F.lit(0.0), F.lit(0.0)), lambda z, x: dd_add((z["hi"], z["lo"]), (x["hi"], x["lo"])))


def dd_to_double(a: Pair, rounding: int = 0) -> Column:
    """hi + lo to nearest (0), or one step outwards: -1 down, 1 up; exact values stay."""
    s, e = two_sum(a[0], a[1])
    if rounding == 0:
        return s
    return F.when(e < 0, dn(s)).otherwise(s) if rounding < 0 else F.when(e > 0, up(s)).otherwise(s)


# --- intervals: (lo, hi) -----------------------------------------------------


def i_add(a: Pair, b: Pair) -> Pair:
    return dn(a[0] + b[0]), up(a[1] + b[1])


def i_sub(a: Pair, b: Pair) -> Pair:
    return dn(a[0] - b[1]), up(a[1] - b[0])


def i_neg(a: Pair) -> Pair:
    return -a[1], -a[0]


def i_mul(a: Pair, b: Pair) -> Pair:
    corners = [a[0] * b[0], a[0] * b[1], a[1] * b[0], a[1] * b[1]]
    return dn(F.least(*corners)), up(F.greatest(*corners))


def i_div(a: Pair, b: Pair) -> Pair:
    bad = (b[0] <= 0) & (b[1] >= 0)
    safe = [F.when(bad, F.raise_error(F.lit("interval division by an interval that holds 0")).cast("double")).otherwise(x) for x in b]
    corners = [x / y for x in a for y in safe]
    return dn(F.least(*corners)), up(F.greatest(*corners))


def i_abs(a: Pair) -> Pair:
    return F.when((a[0] <= 0) & (a[1] >= 0), 0.0).otherwise(F.least(F.abs(a[0]), F.abs(a[1]))), F.greatest(F.abs(a[0]), F.abs(a[1]))


def i_sqrt(a: Pair) -> Pair:
    bad = a[0] < 0
    low = F.when(bad, F.raise_error(F.lit("square root of an interval with negative numbers")).cast("double")).otherwise(a[0])
    return F.greatest(F.lit(0.0), dn(F.sqrt(low))), up(F.sqrt(a[1]))


def i_pow(a: Pair, n: int) -> Pair:
    """x**n over the interval; narrower than a product of the interval with itself."""
    if n == 0:
        return F.lit(1.0), F.lit(1.0)
    if n < 0:
        return i_div((F.lit(1.0), F.lit(1.0)), i_pow(a, -n))
    base = i_abs(a) if n % 2 == 0 else a
    out = [base[0], base[1]]
    for _ in range(n - 1):
        if n % 2 == 0:
            out = [F.greatest(F.lit(0.0), dn(out[0] * base[0])), up(out[1] * base[1])]
        else:
            out = [F.least(dn(out[0] * F.abs(base[0])), dn(out[0] * F.abs(base[0]))), up(out[1] * F.abs(base[1]))]
    return out[0], out[1]


def _wider(c: Column) -> tuple[Column, Column]:
    """c, from a function that is off by two units in the last place at most."""
    return dn(dn(dn(c))), up(up(up(c)))


def i_exp(a: Pair) -> Pair:
    return F.greatest(F.lit(0.0), _wider(F.exp(a[0]))[0]), _wider(F.exp(a[1]))[1]


def i_log(a: Pair) -> Pair:
    low = F.when(a[0] <= 0, F.raise_error(F.lit("logarithm of an interval with numbers that are not positive")).cast("double")).otherwise(a[0])
    return _wider(F.ln(low))[0], _wider(F.ln(a[1]))[1]


def i_cos(a: Pair) -> Pair:
    """Extreme values where the interval, a little widened, holds a multiple of pi; end values elsewhere."""
    pi = 3.141592653589793
    slack = F.greatest(F.abs(a[0]), F.abs(a[1])) * 1e-15 + 1e-15
    lo, hi = (a[0] - slack) / pi, (a[1] + slack) / pi
    even = F.floor(hi / 2) * 2 >= lo
    odd = F.floor((hi - 1) / 2) * 2 + 1 >= lo
    ends = (F.cos(a[0]), F.cos(a[1]))
    least, most = _wider(F.least(*ends))[0], _wider(F.greatest(*ends))[1]
    return F.when(odd, -1.0).otherwise(F.greatest(F.lit(-1.0), least)), F.when(even, 1.0).otherwise(F.least(F.lit(1.0), most))


def i_sin(a: Pair) -> Pair:
    """As i_cos, with extreme values at odd multiples of pi / 2."""
    pi = 3.141592653589793
    slack = F.greatest(F.abs(a[0]), F.abs(a[1])) * 1e-15 + 1e-15
    lo, hi = (a[0] - slack) / pi - 0.5, (a[1] + slack) / pi - 0.5
    even = F.floor(hi / 2) * 2 >= lo
    odd = F.floor((hi - 1) / 2) * 2 + 1 >= lo
    ends = (F.sin(a[0]), F.sin(a[1]))
    least, most = _wider(F.least(*ends))[0], _wider(F.greatest(*ends))[1]
    return F.when(odd, -1.0).otherwise(F.greatest(F.lit(-1.0), least)), F.when(even, 1.0).otherwise(F.least(F.lit(1.0), most))


def i_mid(a: Pair) -> Column:
    return a[0] + (a[1] - a[0]) / 2


def i_rad(a: Pair) -> Column:
    m = i_mid(a)
    return F.greatest(up(a[1] - m), up(m - a[0]))


def i_mag(a: Pair) -> Column:
    return F.greatest(F.abs(a[0]), F.abs(a[1]))


# --- polynomials: arrays of coefficients, ascending ---------------------------


def horner(c: Column, x: Column) -> Column:
    return F.aggregate(F.reverse(c), F.lit(0.0), lambda z, a: z * x + a)


def poly_diff(c: Column) -> Column:
    return F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, k: a * (k + 1))


def poly_integral(c: Column) -> Column:
    return F.concat(F.array(F.lit(0.0)), F.transform(c, lambda a, k: a / (k + 1)))


def poly_shift(c: Column, m: Column) -> Column:
    """Coefficients around m: repeated synthetic division."""
    n = F.size(c)

    def step(z: Column, k: Column) -> Column:
        # One more division of what is left, from the highest coefficient down.
        q = F.aggregate(F.reverse(F.slice(z, k + 1, n - k)), F.array().cast("array<double>"), lambda acc, a: F.concat(F.array(F.when(F.size(acc) == 0, a).otherwise(F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0)) * m + a)), acc))
        return F.concat(F.slice(z, 1, k), q)

    return F.aggregate(F.sequence(F.lit(0), n - 1), c, step)


def i_horner(c: Column, x: Pair) -> Pair:
    """An enclosure of a point polynomial over an interval, by interval Horner."""
    z = F.aggregate(
        F.reverse(c), F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")),
        lambda z, a: let(F.struct(*[e.alias(n) for e, n in zip(i_mul((z["lo"], z["hi"]), x), ("lo", "hi"), strict=True)]), lambda p: F.struct(dn(p["lo"] + a).alias("lo"), up(p["hi"] + a).alias("hi"))),
    )
    return z["lo"], z["hi"]


def poly_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def poly_mul(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b) - 1
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0.0), lambda z, i: z + F.get(a, i) * F.coalesce(F.when(k >= i, F.get(b, k - i)), F.lit(0.0))),
    )
