"""Arrays, typed arrays, objects, maps, sets and JSON text with JavaScript semantics, as Column builders.

Nothing is changed in place: functions that would change an array or a map return the new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.js import INF
from pageloom.functions.numeric import string_of

# --- arrays ---


def map_(a: Column, f: Callable) -> Column:
    return F.transform(a, f)


def filter_(a: Column, f: Callable) -> Column:
    return F.filter(a, f)


def every(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.forall(a, lambda x: F.coalesce(f(x), F.lit(False)))


def some(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.exists(a, lambda x: F.coalesce(f(x), F.lit(False)))


def for_each(a: Column) -> Column:
    """(index, element) pairs to explode."""
    return F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("element")))


entries = for_each


def keys(a: Column) -> Column:
    return F.transform(a, lambda _, i: i)


def values(a: Column) -> Column:
    return a


def push(a: Column, *xs: Column) -> Column:
    return F.concat(a, F.array(*xs))


def unshift(a: Column, *xs: Column) -> Column:
    return F.concat(F.array(*xs), a)


def pop(a: Column) -> Column:
    """The array without its last element, which `array_at(a, -1)` gives."""
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def splice(a: Column, start: int, count: int, *xs: Column) -> Column:
    low = F.least(F.lit(start), F.size(a)) if start >= 0 else F.greatest(F.size(a) + start, F.lit(0))
    tail = F.least(low + max(count, 0), F.size(a))
    middle = [F.array(*xs)] if xs else []
    return F.concat(F.slice(a, 1, low), *middle, F.slice(a, tail + 1, F.size(a)))


def concat(a: Column, *more: Column) -> Column:
    return F.concat(a, *more)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def includes(a: Column, x: Column) -> Column:
    return F.coalesce(F.array_contains(a, x), F.lit(False))


def is_array(kind: T.DataType) -> bool:
    """By the column's type, which is known without its values."""
    return isinstance(kind, T.ArrayType)


def copy_within(a: Column, to: int, start: int, end: int | None = None) -> Column:
    high = F.size(a) if end is None else F.least(F.lit(end), F.size(a))
    n = F.least(high - start, F.size(a) - to)
    return F.transform(a, lambda x, i: F.when((i >= to) & (i < to + n), F.get(a, i - to + start)).otherwise(x))


def flat_map(a: Column, f: Callable) -> Column:
    return F.flatten(F.transform(a, f))


def from_string(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def of(*xs: Column) -> Column:
    return F.array(*xs)


def sort_by(a: Column, order: Callable[[Column, Column], Column]) -> Column:
    """By a comparison that gives a negative number, 0 or a positive one."""
    return F.array_sort(a, lambda x, y: F.signum(order(x, y).cast("double")).cast("int"))


#: Bits of the typed arrays, and whether they are signed.
TYPED = {"Int8": (8, True), "Uint8": (8, False), "Int16": (16, True), "Uint16": (16, False), "Int32": (32, True), "Uint32": (32, False)}


def typed(a: Column, kind: str) -> Column:
    """The elements as a typed array keeps them: cut to its bits, clamped (Uint8Clamped) or rounded (Float32)."""
    if kind == "Float64":
        return F.transform(a, lambda x: x.cast("double"))
    if kind == "Float32":
        return F.transform(a, lambda x: x.cast("float"))
    if kind == "Uint8Clamped":
        return F.transform(a, lambda x: F.when(F.isnan(x.cast("double")), 0).otherwise(F.rint(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(255.0)))).cast("int"))
    bits, signed = TYPED[kind]

    def one(x: Column) -> Column:
        d = x.cast("double")
        low = F.pmod(F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)), F.lit(1 << bits))
        kept = F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low) if signed else low
        return F.when(F.isnan(d) | (F.abs(d) == INF), 0).otherwise(kept).cast("long")

    return F.transform(a, one)


def data_view(b: Column, at: int, bits: int, signed: bool, little: bool = False) -> Column:
    """The number that starts at a byte of a binary value; NULL beyond its end."""
    n = bits // 8
    parts = [F.hex(F.substring(b, at + k + 1, 1)) for k in (range(n - 1, -1, -1) if little else range(n))]
    value = F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)")
    value = F.when(value >= 2 ** (bits - 1), value - F.lit(2**bits).cast("decimal(20,0)")).otherwise(value) if signed else value
    return F.when(F.octet_length(b) >= at + n, value.cast("long"))


# --- objects, Map and Set (map and array columns) ---


def object_keys(m: Column) -> Column:
    return F.map_keys(m)


def object_values(m: Column) -> Column:
    return F.map_values(m)


def object_entries(m: Column) -> Column:
    return F.map_entries(m)


def from_entries(pairs: Column) -> Column:
    """A map of (key, value) pairs; of equal keys the last wins."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def object_is(a: Column, b: Column) -> Column:
    """Object.is: absent is absent, and NaN is NaN."""
    return a.eqNullSafe(b)


def map_get(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def map_has(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key)


def map_set(m: Column, key: Column, value: Column) -> Column:
    """A key that is there keeps its place."""
    return F.when(F.map_contains_key(m, key), F.transform_values(m, lambda k, v: F.when(k == key, value).otherwise(v))).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value)))


def map_delete(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_size(m: Column) -> Column:
    return F.size(m)


def set_of(a: Column) -> Column:
    """The distinct elements in the order of their first place."""
    return F.array_distinct(a)


def set_add(s: Column, x: Column) -> Column:
    return F.when(F.array_contains(s, x), s).otherwise(F.concat(s, F.array(x)))


def set_has(s: Column, x: Column) -> Column:
    return includes(s, x)


def set_delete(s: Column, x: Column) -> Column:
    return F.filter(s, lambda v: v != x)


def set_union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def set_intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def set_difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


# --- JSON ---


def _quoted(s: Column) -> Column:
    """A JSON string; characters below a blank are escaped."""
    text = F.to_json(F.array(s))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def stringify(x: Column, kind: T.DataType) -> Column:
    """JSON.stringify of a column of the given type: NaN, infinities and absent values are null; absent fields stay out."""
    null = F.lit("null")
    if isinstance(kind, T.StringType):
        text = _quoted(x)
    elif isinstance(kind, T.BooleanType):
        text = F.when(x, "true").otherwise("false")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: stringify(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        fields = [F.when(x[f.name].isNotNull(), F.concat(_quoted(F.lit(f.name)), F.lit(":"), stringify(x[f.name], f.dataType))) for f in kind.fields]
        text = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ",") if fields else F.lit(""), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(x), lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(":"), stringify(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.NumericType):
        d = x.cast("double")
        text = F.when(F.isnan(d) | (F.abs(d) == INF), null).otherwise(string_of(x, "number"))
    else:
        text = _quoted(x.cast("string"))
    return F.when(x.isNull(), null).otherwise(text)
