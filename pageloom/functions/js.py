"""Column builders with JavaScript semantics. Strings are counted in code points; absent values are NULL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends that trim() removes.
WHITE = r"[\t\n\x0B\f\r    -     　﻿]+"
INF, NAN = float("inf"), float("nan")


def _literal(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


# --- operators on numbers ---


def divide(a: Column, b: Column) -> Column:
    """x / 0 is an infinity with the sign of x, 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def remainder(a: Column, b: Column) -> Column:
    """The sign of the dividend; NaN for a zero divisor."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b))


def to_int32(x: Column) -> Column:
    d = x.cast("double")
    whole = F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))
    wrapped = F.pmod(whole, F.lit(1 << 32))
    return F.when(F.isnan(d) | (F.abs(d) == INF), 0).when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped).cast("int")


def bit_and(a: Column, b: Column) -> Column:
    return to_int32(a).bitwiseAND(to_int32(b))


def bit_or(a: Column, b: Column) -> Column:
    return to_int32(a).bitwiseOR(to_int32(b))


def bit_xor(a: Column, b: Column) -> Column:
    return to_int32(a).bitwiseXOR(to_int32(b))


def bit_not(a: Column) -> Column:
    return F.bitwise_not(to_int32(a))


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(to_int32(a), n & 31)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(to_int32(a), n & 31)


def shift_right_unsigned(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(F.pmod(to_int32(a).cast("long"), F.lit(1 << 32)), n & 31)


def strict_equal(a: Column, b: Column) -> Column:
    """Absent equals absent; NaN (of floats) equals nothing. For floating columns only."""
    return F.coalesce(a.eqNullSafe(b) & ~F.coalesce(F.isnan(a), F.lit(False)), F.lit(False))


def truthy(x: Column, kind: str) -> Column:
    """ToBoolean; kind: string, number or boolean."""
    if kind == "string":
        return F.coalesce(x != "", F.lit(False))
    if kind == "number":
        return F.coalesce((x != 0) & ~F.isnan(x.cast("double")), F.lit(False))
    return F.coalesce(x, F.lit(False))


def to_number(s: Column) -> Column:
    """ToNumber of a string: blank is 0, anything unreadable NaN; 0x, 0o and 0b prefixes are read."""
    t = trim(s)
    radix = F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 64), 16, 10)).when(t.rlike("^0[oO][0-7]+$"), F.conv(F.substring(t, 3, 64), 8, 10)).when(t.rlike("^0[bB][01]+$"), F.conv(F.substring(t, 3, 64), 2, 10))
    plain = t.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$")
    return F.when(t == "", 0.0).when(radix.isNotNull(), radix.cast("double")).when(t.isin("Infinity", "+Infinity"), INF).when(t == "-Infinity", -INF).when(plain, t.try_cast("double")).when(t.isNotNull(), NAN)


# --- strings ---


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i.cast("int") + 1, F.lit(1))


def _int(i: int | Column) -> Column:
    return i if isinstance(i, Column) else F.lit(i)


def char_at(s: Column, i: int | Column) -> Column:
    i = _int(i)
    return F.when((i < 0) | (i >= F.length(s)), "").otherwise(_at(s, i))


def code_point_at(s: Column, i: int | Column) -> Column:
    i = _int(i)
    return F.when((i >= 0) & (i < F.length(s)), F.ascii(_at(s, i)))


char_code_at = code_point_at


def from_char_code(*codes: int) -> Column:
    return F.lit("".join(map(chr, codes)))


def index_of(s: Column, sub: str, start: int = 0) -> Column:
    if not sub:
        return F.least(F.lit(max(start, 0)), F.length(s))
    return F.locate(sub, s, max(start, 0) + 1) - 1


def last_index_of(s: Column, sub: str) -> Column:
    at = F.instr(F.reverse(s), sub[::-1])
    return F.when(at == 0, -1).otherwise(F.length(s) - len(sub) - at + 1) if sub else F.length(s)


def _clip(s: Column, i: int | Column | None, default: Column) -> Column:
    if i is None:
        return default
    i = _int(i)
    return F.when(i < 0, F.greatest(F.length(s) + i, F.lit(0))).otherwise(F.least(i, F.length(s)))


def slice_(s: Column, start: int, end: int | None = None) -> Column:
    a, b = _clip(s, start, F.lit(0)), _clip(s, end, F.length(s))
    return F.when(b <= a, "").otherwise(F.substring(s, a + 1, b - a))


def substring(s: Column, start: int, end: int | None = None) -> Column:
    """Negative bounds are 0, and bounds the wrong way round are swapped."""
    a = F.least(F.lit(max(start, 0)), F.length(s))
    b = F.length(s) if end is None else F.least(F.lit(max(end, 0)), F.length(s))
    return F.substring(s, F.least(a, b) + 1, F.abs(b - a))


def substr(s: Column, start: int, size: int | None = None) -> Column:
    a = _clip(s, start, F.lit(0))
    return F.substring(s, a + 1, F.length(s) if size is None else F.lit(max(size, 0)))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WHITE}|{WHITE}$", "")


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WHITE}", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, f"{WHITE}$", "")


def split(s: Column, sep: str, limit: int | None = None) -> Column:
    """All parts, or the first `limit` of them; the rest is dropped."""
    parts = F.split(s, _literal(sep), -1) if sep else F.filter(F.split(s, ""), lambda c: c != "")
    return parts if limit is None else F.slice(parts, 1, limit)


def pad_start(s: Column, size: int, fill: str = " ") -> Column:
    return F.when((F.length(s) >= size) | F.lit(fill == ""), s).otherwise(F.lpad(s, size, fill))


def pad_end(s: Column, size: int, fill: str = " ") -> Column:
    return F.when((F.length(s) >= size) | F.lit(fill == ""), s).otherwise(F.rpad(s, size, fill))


def at(s: Column, i: int) -> Column:
    """NULL outside the string; negative positions count from the end."""
    k = F.lit(i) if i >= 0 else F.length(s) + i
    return F.when((k >= 0) & (k < F.length(s)), _at(s, k))


def includes(s: Column, sub: str) -> Column:
    return s.contains(sub)


def replace_first(s: Column, sub: str, new: str) -> Column:
    k = F.locate(sub, s)
    return F.when(k == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), k - 1), F.lit(new), F.substring(s, k + len(sub), F.length(s))))


def replace_all(s: Column, sub: str, new: str) -> Column:
    return F.replace(s, F.lit(sub), F.lit(new))


def match_all(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def search(s: Column, pattern: str) -> Column:
    return F.when(s.rlike(pattern), F.length(F.get(F.split(s, pattern, 2), F.lit(0)))).otherwise(F.when(s.isNotNull(), -1))


def encode_uri_component(s: Column) -> Column:
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode_uri_component(s: Column) -> Column:
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def btoa(s: Column) -> Column:
    """In one line, whatever its length; base64 breaks it after 76 characters."""
    return F.replace(F.base64(F.encode(s, "ISO-8859-1")), F.lit("\r\n"), F.lit(""))


def atob(s: Column) -> Column:
    return F.decode(F.unbase64(s), "ISO-8859-1")


# --- numbers ---


def round_(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x.cast("double") + 0.5).cast("double")


def to_fixed(x: Column, digits: int) -> Column:
    return F.round(x.cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})").cast("string")


def to_radix(x: Column, radix: int) -> Column:
    return F.lower(F.conv(x.cast("long").cast("string"), 10, radix))


def parse_int(s: Column, radix: int = 10) -> Column:
    t = trim(s)
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    body = F.regexp_extract(t, rf"^[+-]?(?i:[{digits}]+)", 0)
    if radix == 10:
        value = body.try_cast("double")
    else:
        value = F.conv(F.regexp_replace(body, "^[+-]", ""), radix, 10).try_cast("double") * F.when(body.startswith("-"), -1).otherwise(1)
    return F.when(body == "", NAN).otherwise(value)


def parse_float(s: Column) -> Column:
    body = F.regexp_extract(trim(s), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return F.when(body == "", NAN).otherwise(body.try_cast("double"))


def is_integer(x: Column) -> Column:
    d = x.cast("double")
    return is_finite(x) & (F.floor(d).cast("double") == d)


def is_safe_integer(x: Column) -> Column:
    return is_integer(x) & (F.abs(x.cast("double")) <= float((1 << 53) - 1))


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != INF), F.lit(False))


def log(x: Column) -> Column:
    d = x.cast("double")
    return F.when(d == 0, -INF).when(d < 0, NAN).otherwise(F.ln(d))


def sqrt(x: Column) -> Column:
    return F.sqrt(x.cast("double"))


def min_(*xs: Column) -> Column:
    """NaN if any is NaN."""
    return _extreme(F.least, INF, xs)


def max_(*xs: Column) -> Column:
    return _extreme(F.greatest, -INF, xs)


def _extreme(pick: Callable, empty: float, xs: tuple) -> Column:
    ds = [x.cast("double") for x in xs]
    if not ds:
        return F.lit(empty)
    bad = F.lit(False)
    for d in ds:
        bad = bad | F.coalesce(F.isnan(d), F.lit(True))
    return F.when(bad, NAN).otherwise(pick(*ds) if len(ds) > 1 else ds[0])


# --- arrays ---


def array_slice(a: Column, start: int, end: int | None = None) -> Column:
    n = F.size(a)
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = n if end is None else F.least(F.lit(end), n) if end >= 0 else n + end
    return F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))


def array_index_of(a: Column, x: Column) -> Column:
    return F.coalesce(F.array_position(a, x), F.lit(0)) - 1


def array_last_index_of(a: Column, x: Column) -> Column:
    k = F.array_position(F.reverse(a), x)
    return F.when(k == 0, -1).otherwise(F.size(a) - k)


def array_find(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(a, test), F.lit(0))


def array_find_last(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.reverse(F.filter(a, test)), F.lit(0))


def array_find_index(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_position(F.transform(a, test), True) - 1


def array_at(a: Column, i: int) -> Column:
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def array_join(a: Column, sep: str = ",") -> Column:
    """Absent elements are empty."""
    return F.array_join(a.cast("array<string>"), sep, "")


def array_sort_default(a: Column) -> Column:
    """By the elements' strings, absent ones last."""
    return F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x.isNull().alias("n"), x.cast("string").alias("s"), x.alias("x")))), lambda t: t["x"])


def array_fill(a: Column, x: Column, start: int = 0, end: int | None = None) -> Column:
    n = F.size(a)
    low = F.lit(start) if start >= 0 else n + start
    high = n if end is None else F.lit(end) if end >= 0 else n + end
    return F.transform(a, lambda v, i: F.when((i >= low) & (i < high), x).otherwise(v))


def array_reduce(a: Column, start: Column, step: Callable) -> Column:
    return F.aggregate(a, start, step)


def array_reduce_right(a: Column, start: Column, step: Callable) -> Column:
    return F.aggregate(F.reverse(a), start, step)


def array_flat(a: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        a = F.flatten(a)
    return a


# --- objects ---


def object_assign(a: Column, b: Column) -> Column:
    """Members of b win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def has_own(a: Column, key: str) -> Column:
    return F.map_contains_key(a, key)


# --- dates (UTC) ---


def iso_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def date_parts(ts: Column) -> dict[str, Column]:
    """The getters: months from 0, days of the week from Sunday = 0."""
    return {"full_year": F.year(ts), "month": F.month(ts) - 1, "date": F.dayofmonth(ts), "day": F.dayofweek(ts) - 1, "hours": F.hour(ts), "minutes": F.minute(ts), "seconds": F.second(ts), "milliseconds": F.date_format(ts, "SSS").cast("int"), "time": F.unix_millis(ts.cast("timestamp"))}


def make_date(year: Column, month: Column, day: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """NULL for a component out of range; two-digit years are of the 1900s."""
    full = F.when(year.between(0, 99), year + 1900).otherwise(year)
    return F.try_make_timestamp(full, month + 1, day, hours, minutes, seconds.cast("decimal(8,6)"))
