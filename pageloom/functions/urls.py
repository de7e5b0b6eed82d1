"""URL functions: resolution in Python for extractors, and Column builders for the parts of a URL."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PORTS = {"http": 80, "https": 443, "ftp": 21}


def resolve(base: str | None, href: str | None) -> str | None:
    """The absolute form: host in lower case, no default port, a path at least, dot segments gone, non-ASCII escaped."""
    try:
        s = urlsplit(urljoin(base or "", (href or "").strip()))
        if not s.scheme:
            return None
        if s.scheme not in _PORTS:
            return urlunsplit(s)
        host = (s.hostname or "").lower()
        if not host:
            return None
        port = f":{s.port}" if s.port and s.port != _PORTS[s.scheme] else ""
        user = s.netloc.rpartition("@")[0]
        path = quote(s.path or "/", safe="/%:@!$&'()*+,;=~-._")
        return urlunsplit((s.scheme, f"{user}@{host}{port}" if user else host + port, path, quote(s.query, safe="/%:@!$&'()*+,;=~-._?"), quote(s.fragment, safe="/%:@!$&'()*+,;=~-._?")))
    except ValueError:
        return None


_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def protocol(url: Column) -> Column:
    return F.when(_part(url, 1) != "", F.concat(F.lower(_part(url, 1)), F.lit(":"))).otherwise("")


def hostname(url: Column) -> Column:
    return F.lower(_part(url, 2))


def port(url: Column) -> Column:
    """Empty for the scheme's default port."""
    p, scheme = _part(url, 3), F.lower(_part(url, 1))
    default = ((scheme == "http") & (p == "80")) | ((scheme == "https") & (p == "443"))
    return F.when(default, "").otherwise(p)


def host(url: Column) -> Column:
    return F.concat(hostname(url), F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(""))


def origin(url: Column) -> Column:
    return F.concat(protocol(url), F.lit("//"), host(url))


def pathname(url: Column) -> Column:
    p = _part(url, 4)
    return F.when((p == "") & (_part(url, 2) != ""), "/").otherwise(p)


def search(url: Column) -> Column:
    return F.when(F.length(_part(url, 5)) > 1, _part(url, 5)).otherwise("")


def hash_(url: Column) -> Column:
    return F.when(F.length(_part(url, 6)) > 1, _part(url, 6)).otherwise("")


def search_params(url: Column) -> Column:
    """The query as array<struct<key, value>>, in order; plus signs are spaces."""
    query = F.substring(search(url), 2, 1 << 30)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    text = lambda s: F.coalesce(F.try_url_decode(s), s)
    return F.transform(pairs, lambda p: F.struct(text(F.substring_index(p, "=", 1)).alias("key"), F.when(F.instr(p, "=") > 0, text(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("value")))


def param_get(url: Column, key: str) -> Column:
    return F.get(F.transform(F.filter(search_params(url), lambda p: p["key"] == key), lambda p: p["value"]), F.lit(0))


def param_all(url: Column, key: str) -> Column:
    return F.transform(F.filter(search_params(url), lambda p: p["key"] == key), lambda p: p["value"])


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def crawl_key(url: Column) -> Column:
    """The key by which a crawl knows a URL: without fragment, in lower case."""
    return F.lower(without_fragment(url))


def search_key(url: Column) -> Column:
    """The key by which search hits are the same: no fragment, one closing slash off, case folded."""
    return F.lower(F.regexp_replace(without_fragment(url), "/$", ""))


def is_page_link(href: str | None) -> bool:
    h = (href or "").strip()
    return bool(h) and not re.match(r"#|javascript:|mailto:", h, re.I)


def resolved(href: Column, base: Column | None = None) -> Column:
    """URL(input, base): the absolute form by `resolve`, NULL for what is no address."""

    @F.pandas_udf("string")
    def apply(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([resolve(b, h) for h, b in zip(hrefs, bases, strict=True)], dtype=object)

    return apply(href, F.lit(None).cast("string") if base is None else base)


# --- searchParams: arrays of (key, value) pairs, as search_params gives them ---


def params_has(params: Column, key: str) -> Column:
    return F.exists(params, lambda p: p["key"] == key)


def params_append(params: Column, key: str, value: Column) -> Column:
    return F.concat(params, F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))))


def params_delete(params: Column, key: str) -> Column:
    return F.filter(params, lambda p: p["key"] != key)


def params_set(params: Column, key: str, value: Column) -> Column:
    """The first pair of the key takes the value and the others go; without one it is appended."""
    earlier = lambda i: F.exists(F.slice(params, 1, i), lambda q: q["key"] == key)
    kept = F.filter(params, lambda p, i: (p["key"] != key) | ~earlier(i))
    new = F.transform(kept, lambda p: F.when(p["key"] == key, F.struct(p["key"].alias("key"), value.alias("value"))).otherwise(p))
    return F.when(params_has(params, key), new).otherwise(params_append(params, key, value))


def params_keys(params: Column) -> Column:
    return F.transform(params, lambda p: p["key"])


def params_values(params: Column) -> Column:
    return F.transform(params, lambda p: p["value"])


def params_size(params: Column) -> Column:
    return F.size(params)


def params_string(params: Column) -> Column:
    """The query text without a question mark; blanks are plus signs."""
    text = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("~"), F.lit("%7E"))
    return F.array_join(F.transform(params, lambda p: F.concat(text(p["key"]), F.lit("="), text(p["value"]))), "&")
