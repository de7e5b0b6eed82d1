"""Coercions, mathematics and whole numbers of any size with JavaScript semantics, as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.js import INF, NAN, is_finite, to_int32, to_number

#: The constants of Math and Number.
CONSTANTS = {
    "E": math.e, "LN10": math.log(10), "LN2": math.log(2), "LOG10E": math.log10(math.e), "LOG2E": math.log2(math.e), "PI": math.pi, "SQRT1_2": math.sqrt(0.5), "SQRT2": math.sqrt(2),
    "EPSILON": 2.0**-52, "MAX_SAFE_INTEGER": 2.0**53 - 1, "MIN_SAFE_INTEGER": 1 - 2.0**53, "MAX_VALUE": (2 - 2.0**-52) * 2.0**1023, "MIN_VALUE": 5e-324, "POSITIVE_INFINITY": INF, "NEGATIVE_INFINITY": -INF, "NaN": NAN,
}


def constant(name: str) -> Column:
    return F.lit(CONSTANTS[name])


# --- coercions; kind is string, number or boolean ---


def number_of(x: Column, kind: str) -> Column:
    """ToNumber; absent is 0, as null is."""
    if kind == "string":
        return F.coalesce(to_number(x), F.lit(0.0))
    return F.coalesce(x.cast("int").cast("double") if kind == "boolean" else x.cast("double"), F.lit(0.0))


def string_of(x: Column, kind: str) -> Column:
    """ToString: whole numbers without a point, absent values `null`."""
    if kind == "number":
        d = x.cast("double")
        whole = (F.abs(d) < 1e21) & (d % 1 == 0)
        plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        small = (F.abs(d) >= 1e-6) & (F.abs(d) < 1e15)
        text = F.when(F.isnan(d), "NaN").when(d == INF, "Infinity").when(d == -INF, "-Infinity").when(whole, d.cast("decimal(38,0)").cast("string")).when(small & d.cast("string").contains("E"), plain)
        x = text.otherwise(F.lower(F.regexp_replace(F.regexp_replace(d.cast("string"), r"E(\d)", "e+$1"), r"\.0e", "e")))
    return F.coalesce(x.cast("string"), F.lit("null"))


def plus(a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """The + operator: text if either side is text, else a sum."""
    if "string" in kinds:
        return F.concat(string_of(a, kinds[0]), string_of(b, kinds[1]))
    return number_of(a, kinds[0]) + number_of(b, kinds[1])


def loose_equal(a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """The == operator: absent equals only absent; of different kinds the numbers are compared."""
    if kinds[0] == kinds[1]:
        same = a == b
        if kinds[0] == "number":
            same = same & ~F.isnan(a.cast("double"))
    else:
        x, y = number_of(a, kinds[0]), number_of(b, kinds[1])
        same = (x == y) & ~F.isnan(x)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def less(a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """The < operator: two texts by their characters, else numbers; NaN is never less."""
    if kinds == ("string", "string"):
        return a < b
    x, y = number_of(a, kinds[0]), number_of(b, kinds[1])
    return (x < y) & ~F.isnan(x) & ~F.isnan(y)


def is_nan(x: Column, kind: str) -> Column:
    """The global isNaN, which coerces."""
    return F.isnan(number_of(x, kind))


def is_finite_value(x: Column, kind: str) -> Column:
    return is_finite(number_of(x, kind))


def boolean_string(x: Column) -> Column:
    return F.when(x, "true").when(~x, "false")


# --- mathematics ---

#: Functions of one number that Spark has under the same name and with the same result, NaN outside their domain.
_SAME = {"abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "expm1": F.expm1, "cbrt": F.cbrt, "sign": F.signum}


def math_of(name: str, x: Column) -> Column:
    return _SAME[name](x.cast("double"))


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y.cast("double"), x.cast("double"))


def hypot(*xs: Column) -> Column:
    return F.sqrt(sum((x.cast("double") * x.cast("double") for x in xs), F.lit(0.0)))


def ceil(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def trunc(x: Column) -> Column:
    return F.when(x >= 0, floor(x)).otherwise(ceil(x))


def log2(x: Column) -> Column:
    d = x.cast("double")
    return F.when(d == 0, -INF).when(d < 0, NAN).otherwise(F.log2(d))


def log10(x: Column) -> Column:
    d = x.cast("double")
    return F.when(d == 0, -INF).when(d < 0, NAN).otherwise(F.log10(d))


def power(x: Column, y: Column) -> Column:
    """NaN for a NaN exponent, and for one of infinite size on a base of 1 or -1."""
    a, b = x.cast("double"), y.cast("double")
    return F.when(F.isnan(b) | ((F.abs(a) == 1) & (F.abs(b) == INF)), NAN).otherwise(F.pow(a, b))


def imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, signed."""
    product = to_int32(a).cast("decimal(38,0)") * to_int32(b).cast("decimal(38,0)")
    low = F.pmod(product, F.lit(1 << 32).cast("decimal(38,0)")).cast("long")
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


# --- whole numbers of up to 38 digits ---


def big_int(x: Column) -> Column:
    """NULL for what is not a whole number in digits."""
    return F.when(x.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x.cast("string")).try_cast("decimal(38,0)"))


def big_divide(a: Column, b: Column) -> Column:
    """Toward zero; NULL for a zero divisor."""
    return F.when(b != 0, F.floor(F.abs(a.cast("decimal(38,0)")) / F.abs(b.cast("decimal(38,0)"))) * F.signum(a.cast("double")).cast("int") * F.signum(b.cast("double")).cast("int")).cast("decimal(38,0)")


def big_remainder(a: Column, b: Column) -> Column:
    return F.try_mod(a.cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("decimal(38,0)")
