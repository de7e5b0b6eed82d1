import base64

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pageloom.functions import js, urls


def value(spark, column, text=None):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("v")).first().v


def test_strings(spark):
    S = F.col("s")  # noqa: N806
    cases = [
        (js.char_at(S, 1), "abc", "b"), (js.char_at(S, 9), "abc", ""), (js.code_point_at(S, 0), "a", 97), (js.code_point_at(S, 5), "a", None), (js.index_of(S, "b"), "abcb", 1), (js.index_of(S, "z"), "abc", -1),
        (js.last_index_of(S, "b"), "abcb", 3), (js.last_index_of(S, "z"), "abc", -1), (js.slice_(S, -2), "abc", "bc"), (js.slice_(S, 2, 1), "abc", ""), (js.substring(S, 2, 0), "abc", "ab"), (js.substr(S, -2, 1), "abc", "b"),
        (js.trim(S), "\t a  \n", "a"), (js.trim_start(S), " a ", "a "), (js.trim_end(S), " a ", " a"), (js.split(S, ",", 2), "a,b,c", ["a", "b"]), (js.split(S, ""), "ab", ["a", "b"]), (js.split(S, "."), "a.b", ["a", "b"]),
        (js.pad_start(S, 2, "x"), "abc", "abc"), (js.pad_start(S, 4, "x"), "abc", "xabc"), (js.pad_end(S, 4, "x"), "abc", "abcx"), (js.at(S, -1), "abc", "c"), (js.at(S, 3), "abc", None), (js.replace_first(S, "a", "x"), "aa", "xa"),
        (js.replace_all(S, "a", "x"), "aa", "xx"), (js.match_all(S, "[0-9]"), "a1b2", ["1", "2"]), (js.search(S, "b+"), "abb", 1), (js.search(S, "z"), "abb", -1), (js.encode_uri_component(S), "a b&é!*", "a%20b%26%C3%A9!*"),
        (js.decode_uri_component(S), "a%20b+c", "a b+c"), (js.btoa(S), "é", "6Q=="), (js.atob(S), "6Q==", "é"), (js.parse_int(S), " 12px", 12.0), (js.parse_int(S, 16), "-ff", -255.0), (js.parse_float(S), "1.5e1x", 15.0),
        (js.to_number(S), "", 0.0), (js.to_number(S), "0x1f", 31.0), (js.to_number(S), " 1e3 ", 1000.0), (js.truthy(S, "string"), "", False), (js.truthy(S, "string"), None, False),
        (urls.hostname(S), "http://A.com:80/x", "a.com"), (urls.port(S), "http://A.com:80/x", ""), (urls.port(S), "http://A.com:81/x", "81"), (urls.pathname(S), "http://a.com", "/"), (urls.search(S), "http://a.com/?", ""),
        (urls.hash_(S), "http://a.com/#q", "#q"), (urls.origin(S), "HTTP://A.com:81/x", "http://a.com:81"), (urls.param_get(S, "b"), "http://a/?a=1&b=x+y%21", "x y!"), (urls.param_all(S, "a"), "http://a/?a=1&a=2", ["1", "2"]), (urls.search_key(S), "HTTP://A.com/x/#f", "http://a.com/x"),
    ]
    for column, text, want in cases:
        assert value(spark, column, text) == want, column


def test_base64_in_one_line(spark):
    text = "x" * 58 + "é"
    coded = base64.b64encode(text.encode("latin-1")).decode()
    assert value(spark, js.btoa(F.col("s")), text) == coded and value(spark, js.atob(F.col("s")), coded) == text


def test_uri_and_bytes_of_odd_addresses(spark, tmp_path):
    """Long, empty, missing and non-Latin addresses against the SQL."""
    rows = [(k, u, u) for k, u in enumerate(["https://a.org/" + "p/" * 60, "", None, "https://a.org/é?q=ß", "https://日本.org/😀", "http://a/%2F%20~*!'()+ x"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, entry.QUERIES["js_uri_and_bytes"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"create view pages as from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(db.execute(entry.ORACLES["js_uri_and_bytes"]).fetchall())


def test_numbers(spark):
    d = lambda x: F.lit(float(x))
    inf = float("inf")
    cases = [(js.divide(d(1), d(0)), inf), (js.divide(d(-1), d(0)), -inf), (js.divide(d(6), d(4)), 1.5), (js.remainder(d(-7), d(3)), -1.0), (js.round_(d(-2.5)), -2.0), (js.round_(d(2.5)), 3.0), (js.to_int32(d(2**31)), -(2**31)), (js.to_int32(d(-1.9)), -1), (js.shift_right_unsigned(d(-1), 28), 15), (js.bit_not(d(5)), -6), (js.log(d(0)), -inf), (js.to_fixed(d(1.005), 1), "1.0"), (js.to_radix(d(255), 16), "ff"), (js.is_integer(d(2)), True), (js.is_finite(d(inf)), False), (js.max_(d(1), d(3)), 3.0)]
    assert [value(spark, c) for c, _ in cases] == [w for _, w in cases]
    nan = [js.divide(d(0), d(0)), js.remainder(d(1), d(0)), js.min_(d(1), d("nan")), js.log(d(-1)), js.to_number(F.lit("x")), js.parse_int(F.lit("x"))]
    assert all(value(spark, c) != value(spark, c) for c in nan)


def test_arrays(spark):
    a = F.array(*map(F.lit, (3, 10, 2, 10)))
    cases = [(js.array_slice(a, -2), [2, 10]), (js.array_slice(a, 1, -1), [10, 2]), (js.array_index_of(a, F.lit(10)), 1), (js.array_last_index_of(a, F.lit(10)), 3), (js.array_find(a, lambda x: x > 3), 10), (js.array_find_index(a, lambda x: x < 3), 2), (js.array_find_last(a, lambda x: x < 4), 2), (js.array_at(a, -1), 10), (js.array_at(a, 9), None), (js.array_join(F.array(F.lit(1), F.lit(None))), "1,"), (js.array_sort_default(a), [10, 10, 2, 3]), (js.array_fill(a, F.lit(0), 1, 3), [3, 0, 0, 10]), (js.array_reduce(a, F.lit(0), lambda x, y: x + y), 25)]
    assert [value(spark, c) for c, _ in cases] == [w for _, w in cases]
    m, n = F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))
    assert value(spark, js.object_assign(m, n)) == {"a": 2, "b": 3}


@pytest.mark.parametrize("base,href,want", [("http://A.com/x/y", "z", "http://a.com/x/z"), ("http://a.com:80/x", "//B.org", "http://b.org/"), ("http://a.com/x", "../für?ü", "http://a.com/f%C3%BCr?%C3%BC"), (None, "x", None), ("http://a.com", "http://[bad", None), ("http://a.com", "tel:1", "tel:1")])
def test_resolve(base, href, want):
    assert urls.resolve(base, href) == want
