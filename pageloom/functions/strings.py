"""String, regular expression and encoding functions with JavaScript semantics, as Column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.js import _literal, decode_uri_component, encode_uri_component

#: The characters that encodeURI leaves as they are beside those of encodeURIComponent.
RESERVED = ";/?:@&=+$,#"


def char_code_at(s: Column, i: int | Column) -> Column:
    """The UTF-16 unit at a position counted in UTF-16 units; NULL outside the string."""
    at = i if isinstance(i, Column) else F.lit(i)
    units = F.hex(F.encode(s, "UTF-16BE"))
    return F.when((at >= 0) & (at * 4 < F.length(units)), F.conv(F.substring(units, at * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def utf16_length(s: Column) -> Column:
    return F.floor(F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def from_char_code(codes: Column) -> Column:
    """The string of an array of UTF-16 units, each cut to 16 bits."""
    unit = lambda c: F.lpad(F.hex(F.pmod(c.cast("long"), F.lit(65536))), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(codes, unit), "")), "UTF-16BE")


def starts_with(s: Column, sub: str, at: int = 0) -> Column:
    return F.substring(s, max(at, 0) + 1, len(sub)) == sub if sub else s.isNotNull()


def ends_with(s: Column, sub: str, end: int | None = None) -> Column:
    return s.endswith(sub) if end is None else F.substring(s, F.lit(1), F.least(F.lit(max(end, 0)), F.length(s))).endswith(sub)


def concat(s: Column, *more: Column) -> Column:
    """Absent values read `null`."""
    return F.concat(*(F.coalesce(x.cast("string"), F.lit("null")) for x in (s, *more)))


def repeat(s: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("RangeError: a string cannot be repeated a negative number of times")
    return F.repeat(s, n)


def code_points(s: Column) -> Column:
    """The iterator: an array of one-character strings."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def normalize(s: Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError("RangeError: the form is NFC, NFD, NFKC or NFKD")

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize(form, v))

    return F.when(s.rlike(r"^[\x00-\x7F]*$"), s).otherwise(apply(s))


# --- regular expressions (Java's; groups in replacements read $1) ---


def split_regex(s: Column, pattern: str, limit: int | None = None) -> Column:
    parts = F.split(s, pattern, -1)
    return parts if limit is None else F.slice(parts, 1, limit)


def test(s: Column, pattern: str) -> Column:
    return F.coalesce(s.rlike(pattern), F.lit(False))


def exec_(s: Column, pattern: str, groups: int = 0) -> Column:
    """The first match and its groups, or NULL. A group that takes no part is an empty string."""
    return F.when(s.rlike(pattern), F.array(*(F.regexp_extract(s, pattern, k) for k in range(groups + 1))))


match = exec_


def match_groups(s: Column, pattern: str, groups: int) -> Column:
    """matchAll: an array of arrays, the match and its groups."""
    each = [F.regexp_extract_all(s, F.lit(pattern), F.lit(k)) for k in range(groups + 1)]
    return F.transform(each[0], lambda _, i: F.array(*(F.get(e, i) for e in each)))


def replace_regex(s: Column, pattern: str, new: str, every: bool = True) -> Column:
    """All matches, or the first only."""
    if every:
        return F.regexp_replace(s, pattern, new)
    first = F.regexp_extract(s, pattern, 0)
    k = F.when(s.rlike(pattern), F.length(F.get(F.split(s, pattern, 2), F.lit(0))))
    put = F.regexp_replace(first, pattern, new)
    return F.when(k.isNull(), s).otherwise(F.concat(F.substring(s, F.lit(1), k), put, F.substring(s, k + F.length(first) + 1, F.length(s))))


# --- encodings ---


def encode_uri(s: Column) -> Column:
    out = encode_uri_component(s)
    for c in RESERVED:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def decode_uri(s: Column) -> Column:
    """Escapes of the reserved characters stay."""
    for c in RESERVED:
        s = F.regexp_replace(s, f"(?i)%{ord(c):02x}", f"%25{ord(c):02X}")
    return decode_uri_component(s)


def text_encode(s: Column) -> Column:
    """UTF-8 bytes as numbers of 0 to 255."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def text_decode(b: Column) -> Column:
    return F.decode(b, "UTF-8")


def digest(s: Column, algorithm: str) -> Column:
    """SHA-1, SHA-256, SHA-384 or SHA-512, in hexadecimal digits."""
    bits = int(algorithm.upper().removeprefix("SHA-"))
    return F.sha1(s) if bits == 1 else F.sha2(s, bits)


def random_uuid() -> Column:
    return F.uuid()


def literal_pattern(text: str) -> str:
    """A pattern that matches the text itself."""
    return _literal(text)
