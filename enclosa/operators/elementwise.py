"""Element-wise arithmetic, functions, comparisons, Boolean algebra and conversions.

Two matrices meet in one equi-join on keys and indices; everything else is a
projection.  There is no broadcasting: shapes must be equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enclosa.functions import expr as X
from enclosa.types import VALUES, DomainError, InvalidArgumentError, Matrix, StateError, is_ordered, same_shape

Values = tuple[Column, ...]


def _of(a: Matrix, suffix: str = "") -> Values:
    return tuple(F.col(c + suffix) for c in a.values)


def zipped(a: Matrix, b: Matrix, body: Callable[[Values, Values], Values], elem: str | None = None, what: str = "element-wise") -> Matrix:
    """``body`` of the elements at the same place."""
    same_shape(a, b, what)
    if a.elem != b.elem:
        raise InvalidArgumentError(f"{what}: elements {a.elem} and {b.elem}")
    other = b.df.select(*b.keys, *[F.col(c).alias(c + "_b") for c in b.values])
    return _put(a, a.df.join(other, a.keys), body(_of(a), tuple(F.col(c + "_b") for c in b.values)), elem)


def mapped(a: Matrix, body: Callable[[Values], Values], elem: str | None = None) -> Matrix:
    return _put(a, a.df, body(_of(a)), elem)


def _put(a: Matrix, df, values: Values, elem: str | None) -> Matrix:
    return Matrix(placed(df, a.keys, values, VALUES[elem or a.elem]), a.rows, a.cols, elem or a.elem, a.by)


def placed(df: DataFrame, keys: list[str], values: Values, names: tuple[str, ...]) -> DataFrame:
    """``keys`` and the values under these names.

    Two projections: within one, a name inside a lambda function can mean the
    value just given that name in place of the column.
    """
    d = df.select(*keys, *[v.alias(f"_new_{n}") for v, n in zip(values, names, strict=True)])
    return d.select(*keys, *[F.col(f"_new_{n}").alias(n) for n in names])


def scalar(a: Matrix, x: float) -> Values:
    """A number as an element of a's kind."""
    if a.elem == "dd":
        return F.lit(float(x)), F.lit(0.0)
    if a.elem == "poly":
        return (F.array(F.lit(float(x))),)
    if a.elem == "int":
        return (F.lit(int(x)),)
    return tuple(F.lit(float(x)) for _ in a.values)


def _dd(c: Column) -> Values:
    return c["hi"], c["lo"]


def _add(e: str, x: Values, y: Values) -> Values:
    return {"interval": X.i_add, "dd": lambda p, q: _dd(X.dd_add(p, q)), "poly": lambda p, q: (X.poly_add(p[0], q[0]),)}.get(e, lambda p, q: (p[0] + q[0],))(x, y)


def _neg(e: str, x: Values) -> Values:
    return {"interval": X.i_neg, "dd": X.dd_neg, "poly": lambda p: (F.transform(p[0], lambda c: -c),)}.get(e, lambda p: (-p[0],))(x)


def _sub(e: str, x: Values, y: Values) -> Values:
    return X.i_sub(x, y) if e == "interval" else (x[0] - y[0],) if e in ("double", "int") else _add(e, x, _neg(e, y))


def _mul(e: str, x: Values, y: Values) -> Values:
    return {"interval": X.i_mul, "dd": lambda p, q: _dd(X.dd_mul(p, q)), "poly": lambda p, q: (X.poly_mul(p[0], q[0]),)}.get(e, lambda p, q: (p[0] * q[0],))(x, y)


def _div(e: str, x: Values, y: Values) -> Values:
    if e == "poly":
        raise StateError("polynomial elements do not divide")
    return {"interval": X.i_div, "dd": lambda p, q: _dd(X.dd_div(p, q)), "int": lambda p, q: (F.when(q[0] != 0, (p[0] / F.when(q[0] != 0, q[0])).cast("int")),)}.get(e, lambda p, q: (X.ieee_div(p[0], q[0]),))(x, y)


def add(a: Matrix | float, b: Matrix | float) -> Matrix:
    return _either(a, b, _add, "add")


def subtract(a: Matrix | float, b: Matrix | float) -> Matrix:
    return _either(a, b, _sub, "subtract")


def scale(a: Matrix | float, b: Matrix | float) -> Matrix:
    """A matrix times a number; the product of two matrices is another operator."""
    if isinstance(a, Matrix) and isinstance(b, Matrix):
        raise InvalidArgumentError("scale takes one matrix and one number")
    return _either(a, b, _mul, "scale")


def divide(a: Matrix | float, b: Matrix | float) -> Matrix:
    """A number by each element, or each element by a number; matrices are not divided by matrices."""
    if isinstance(a, Matrix) and isinstance(b, Matrix):
        raise InvalidArgumentError("divide takes one matrix and one number")
    return _either(a, b, _div, "divide")


def _either(a: Matrix | float, b: Matrix | float, f: Callable, what: str) -> Matrix:
    if isinstance(a, Matrix) and isinstance(b, Matrix):
        return zipped(a, b, lambda x, y: f(a.elem, x, y), what=what)
    if isinstance(a, Matrix):
        return mapped(a, lambda x: f(a.elem, x, scalar(a, b)))
    if isinstance(b, Matrix):
        return mapped(b, lambda x: f(b.elem, scalar(b, a), x))
    raise InvalidArgumentError(f"{what} needs a matrix")


def plus(a: Matrix) -> Matrix:
    return a


def negate(a: Matrix) -> Matrix:
    return mapped(a, lambda x: _neg(a.elem, x))


def power(a: Matrix | float, b: Matrix | float) -> Matrix:
    """Element by element.  Whole exponents are products, so they are the same in every engine."""
    if isinstance(a, Matrix) and isinstance(b, Matrix):
        return zipped(a, b, lambda x, y: (F.pow(x[0], y[0]),), what="power")
    if isinstance(a, Matrix):
        if float(b).is_integer() and abs(b) <= 64:
            n = int(b)
            if a.elem == "interval":
                return mapped(a, lambda x: X.i_pow(x, n))
            if a.elem == "dd":
                return _dd_power(a, n)
            return mapped(a, lambda x: (X.int_pow(x[0], n),))
        return mapped(a, lambda x: (F.pow(x[0], F.lit(float(b))),))
    if isinstance(b, Matrix):
        return mapped(b, lambda x: (F.pow(F.lit(float(a)), x[0]),))
    raise InvalidArgumentError("power needs a matrix")


def _dd_power(a: Matrix, n: int) -> Matrix:
    if n < 1:
        raise DomainError(f"double-double power {n}")

    def body(x: Values) -> Values:
        own = F.struct(x[0].alias("hi"), x[1].alias("lo"))
        return _dd(F.aggregate(F.sequence(F.lit(2), F.lit(n)) if n > 1 else F.array().cast("array<int>"), own, lambda z, _: X.dd_mul((z["hi"], z["lo"]), x)))

    return mapped(a, body)


def _function(name: str, plain: Callable[[Column], Column], interval: Callable | None = None) -> Callable[[Matrix], Matrix]:
    def f(a: Matrix) -> Matrix:
        if a.elem == "interval" and interval is not None:
            return mapped(a, interval)
        if a.elem != "double":
            raise StateError(f"{name} of {a.elem} elements")
        return mapped(a, lambda x: (plain(x[0]),))

    f.__name__ = name
    f.__doc__ = f"{name} of each element."
    return f


absolute = _function("absolute", F.abs, X.i_abs)
sqrt = _function("sqrt", F.sqrt, X.i_sqrt)
sin = _function("sin", F.sin, X.i_sin)
cos = _function("cos", F.cos, X.i_cos)
exp = _function("exp", F.exp, X.i_exp)
log = _function("log", X.ieee_ln, X.i_log)


def compare(a: Matrix, b: Matrix, op: str) -> Matrix:
    """A Boolean matrix of a op b, for op among < <= > >= == !=.

    NaN equals itself and is the greatest number.  Intervals: < where every
    number of one is below every number of the other; == where both are the same
    point; != where they are disjoint.
    """
    if not is_ordered(a.elem):
        raise StateError(f"{a.elem} elements do not compare")
    plain = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}
    if op not in plain:
        raise InvalidArgumentError(f"comparison {op}")

    def body(x: Values, y: Values) -> Values:
        if a.elem == "interval":
            return ({"<": x[1] < y[0], "<=": x[1] <= y[0], ">": x[0] > y[1], ">=": x[0] >= y[1], "==": (x[0] == x[1]) & (y[0] == y[1]) & (x[0] == y[0]), "!=": (x[1] < y[0]) | (x[0] > y[1])}[op],)
        if a.elem == "dd":
            same = x[0] == y[0]
            return ({"==": same & (x[1] == y[1]), "!=": ~(same & (x[1] == y[1]))}.get(op, F.when(same, plain[op](x[1], y[1])).otherwise(plain[op](x[0], y[0]))),)
        return (plain[op](x[0], y[0]),)

    return zipped(a, b, body, "bool", f"compare {op}")


def both(a: Matrix, b: Matrix) -> Matrix:
    _need_bool(a, b)
    return zipped(a, b, lambda x, y: (x[0] & y[0],))


def either(a: Matrix, b: Matrix) -> Matrix:
    _need_bool(a, b)
    return zipped(a, b, lambda x, y: (x[0] | y[0],))


def flip(a: Matrix) -> Matrix:
    _need_bool(a)
    return mapped(a, lambda x: (~x[0],))


def _need_bool(*some: Matrix) -> None:
    for a in some:
        if a.elem != "bool":
            raise StateError(f"a Boolean operator on {a.elem} elements")


def quantified(a: Matrix, which: str):
    """all, any or none of a Boolean matrix, one row for each key; of no elements: true, false, true."""
    _need_bool(a)
    all_, any_ = F.coalesce(F.bool_and("v"), F.lit(True)), F.coalesce(F.bool_or("v"), F.lit(False))
    out = {"all": all_, "any": any_, "none": ~any_}[which].alias("v")
    return a.df.groupBy(*a.by).agg(out) if a.by else a.df.agg(out)


# --- conversions -------------------------------------------------------------


def convert(a: Matrix, elem: str, rounding: int = 0) -> Matrix:
    """The matrix with elements of another kind.

    Points become degenerate intervals and intervals their midpoints.
    Double-double to double rounds to nearest, or outwards by ``rounding``; an
    interval of double-doubles becomes an interval that holds it.
    """
    e = a.elem
    zero = F.lit(0.0)
    if e == elem:
        return a
    table: dict[tuple[str, str], Callable[[Values], Values]] = {
        ("int", "double"): lambda x: (x[0].cast("double"),),
        ("int", "interval"): lambda x: (x[0].cast("double"), x[0].cast("double")),
        ("int", "dd"): lambda x: (x[0].cast("double"), zero),
        ("double", "int"): lambda x: (x[0].cast("int"),),
        ("double", "interval"): lambda x: (x[0], x[0]),
        ("double", "dd"): lambda x: (x[0], zero),
        ("double", "interval_dd"): lambda x: (x[0], zero, x[0], zero),
        ("double", "poly"): lambda x: (F.array(x[0]),),
        ("interval", "double"): lambda x: (X.i_mid(x),),
        ("interval", "dd"): lambda x: _dd(_half_dd(x)),
        ("interval", "interval_dd"): lambda x: (x[0], zero, x[1], zero),
        ("dd", "double"): lambda x: (X.dd_to_double(x, rounding),),
        ("dd", "interval"): lambda x: (X.dd_to_double(x, -1), X.dd_to_double(x, 1)),
        ("dd", "interval_dd"): lambda x: (x[0], x[1], x[0], x[1]),
        ("interval_dd", "interval"): lambda x: (X.dd_to_double((x[0], x[1]), -1), X.dd_to_double((x[2], x[3]), 1)),
        ("interval_dd", "dd"): lambda x: _dd(X.let(X.dd_add((x[0], x[1]), (x[2], x[3])), lambda s: F.struct((s["hi"] / 2).alias("hi"), (s["lo"] / 2).alias("lo")))),
        ("interval_dd", "double"): lambda x: ((x[0] + x[2]) / 2,),
    }
    if (e, elem) not in table:
        raise InvalidArgumentError(f"no conversion from {e} to {elem}")
    return mapped(a, table[e, elem], elem)


def _half_dd(x: Values) -> Column:
    s, r = X.two_sum(x[0], x[1])
    return F.struct((s / 2).alias("hi"), (r / 2).alias("lo"))


def convert_decimal(c: Column, elem: str = "dd") -> Column:
    """A decimal column as a double-double struct: the nearest double and what is left."""
    hi = c.cast("double")
    return F.struct(hi.alias("hi"), (c - hi.cast("decimal(38,18)")).cast("double").alias("lo"))
