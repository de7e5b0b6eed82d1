"""Edge cases of functions and operators that the oracles' tables do not have."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import containers, js, numeric, strings, urls
from pageloom.operators import crawl, css, dom, search, storage
from pageloom.sources.pages import parse_pages

NAN, INF = float("nan"), float("inf")


def values(spark, cases):
    """The first value of each column, read at once."""
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first())


def check(spark, cases):
    for got, (column, want) in zip(values(spark, cases), cases, strict=True):
        assert got == want, (column, got, want)


def test_strings(spark):
    s = F.lit
    check(spark, [
        (strings.char_code_at(s("a😀"), 1), 0xD83D), (strings.char_code_at(s("a"), 1), None), (strings.char_code_at(s("a"), -1), None), (strings.utf16_length(s("a😀")), 3), (strings.from_char_code(F.array(s(0xD83D), s(0xDE00), s(65601))), "😀A"), (strings.starts_with(s("abc"), ""), True),
        (strings.starts_with(s("abc"), "bc", 1), True), (strings.ends_with(s("abc"), "b", 2), True), (strings.repeat(s("ab"), 0), ""), (strings.concat(s("a"), s(None)), "anull"), (strings.code_points(s("a😀")), ["a", "😀"]), (strings.normalize(s("é")), "é"), (strings.normalize(s("ﬁ"), "NFKC"), "fi"),
        (strings.split_regex(s("a1b22c"), "[0-9]+", 2), ["a", "b"]), (strings.test(s(None).cast("string"), "a"), False), (strings.exec_(s("x-12"), "([a-z])-(\\d)", 2), ["x-1", "x", "1"]), (strings.exec_(s("q"), "z"), None), (strings.replace_regex(s("a.b.c"), r"\.", "-", every=False), "a-b.c"), (strings.replace_regex(s("abc"), "(b)(c)", "$2$1"), "acb"),
        (strings.encode_uri(s("http://h/é?a=b c&d#e")), "http://h/%C3%A9?a=b%20c&d#e"), (strings.decode_uri(s("%C3%A9%20%2Fx%3f")), "é %2Fx%3F"), (strings.text_encode(s("é")), [195, 169]), (strings.text_encode(s("")), []), (strings.digest(s("a"), "SHA-1"), "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"),
    ])
    for wrong in (lambda: strings.repeat(s("a"), -1), lambda: strings.normalize(s("a"), "X")):
        with pytest.raises(ValueError, match="RangeError"):
            wrong()


def test_numbers_and_operators(spark):
    s, d = F.lit, lambda x: F.lit(float(x))
    text, number, truth = "string", "number", "boolean"
    check(spark, [
        (numeric.string_of(d(1), number), "1"), (numeric.string_of(d(1e20), number), "100000000000000000000"), (numeric.string_of(d(1e21), number), "1e+21"), (numeric.string_of(d(0.00001), number), "0.00001"), (numeric.string_of(d(1.5e-7), number), "1.5e-7"), (numeric.string_of(d(NAN), number), "NaN"), (numeric.string_of(d(-INF), number), "-Infinity"),
        (numeric.plus(s("1"), s(2), (text, number)), "12"), (numeric.plus(s(True), s(2), (truth, number)), 3.0), (numeric.plus(s(None), s("a"), (number, text)), "nulla"), (numeric.loose_equal(s("2"), s(2), (text, number)), True), (numeric.loose_equal(s(None), s(0), (number, number)), False), (numeric.loose_equal(s(None), s(None), (number, text)), True),
        (numeric.loose_equal(d(NAN), d(NAN), (number, number)), False), (numeric.loose_equal(s(True), s("1"), (truth, text)), True), (numeric.less(s("10"), s("9"), (text, text)), True), (numeric.less(s("10"), s(9), (text, number)), False), (numeric.is_nan(s("x"), text), True), (numeric.is_finite_value(s("1e3"), text), True), (numeric.trunc(d(-1.5)), -1.0),
        (numeric.imul(s(0xFFFFFFFF), s(5)), -5), (numeric.power(d(1), d(INF)) != numeric.power(d(1), d(INF)), False), (numeric.hypot(s(3), s(4)), 5.0), (numeric.log10(d(0)), -INF), (numeric.big_int(s(" 12 ")).cast("string"), "12"), (numeric.big_int(s("1.5")), None), (numeric.big_divide(s(-7), s(2)).cast("int"), -3), (numeric.big_remainder(s(-7), s(2)).cast("int"), -1), (numeric.constant("MAX_SAFE_INTEGER"), 9007199254740991.0),
    ])


def test_containers(spark):
    a = F.array(*map(F.lit, (1, 2, 3)))
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("a", 3))))
    empty = F.array().cast("array<int>")
    check(spark, [
        (containers.pop(empty), []), (containers.shift(a), [2, 3]), (containers.splice(a, -1, 5, F.lit(9)), [1, 2, 9]), (containers.splice(a, 9, 1), [1, 2, 3]), (containers.copy_within(a, 1, 0), [1, 1, 2]), (containers.includes(empty, F.lit(1)), False), (containers.sort_by(a, lambda x, y: y - x), [3, 2, 1]),
        (containers.typed(F.array(F.lit(-1.5), F.lit(300.7), F.lit(NAN)), "Uint8"), [255, 44, 0]), (containers.typed(F.array(F.lit(-1.5), F.lit(300.7), F.lit(2.5)), "Uint8Clamped"), [0, 255, 2]), (containers.data_view(F.unhex(F.lit("FFFE")), 0, 16, True), -2), (containers.data_view(F.unhex(F.lit("FFFE")), 1, 16, True), None),
        (containers.from_entries(pairs), {"b": 2, "a": 3}), (containers.map_set(m, F.lit("a"), F.lit(9)), {"a": 9, "b": 2}), (containers.map_delete(m, F.lit("a")), {"b": 2}), (containers.map_get(m, F.lit("z")), None), (containers.set_add(a, F.lit(3)), [1, 2, 3]), (containers.object_is(F.lit(None), F.lit(None)), True), (containers.every(empty, lambda x: x > 0), True), (containers.some(empty, lambda x: x > 0), False),
    ])
    assert containers.is_array(T.ArrayType(T.LongType())) and not containers.is_array(T.StringType())
    row = spark.createDataFrame([(NAN, 1.0, None, 'q"\n', [1.5, None], {"k": True})], "a double, b double, c string, d string, e array<double>, f map<string,boolean>").select(F.struct("*").alias("v"))
    assert row.select(containers.stringify(F.col("v"), row.schema["v"].dataType).alias("j")).first().j == '{"a":null,"b":1,"d":"q\\"\\n","e":[1.5,null],"f":{"k":true}}'


def test_search_params(spark):
    p = urls.search_params(F.lit("http://h/?a=1&b=x+y&a=2&c"))
    check(spark, [(urls.params_string(urls.params_set(p, "a", F.lit("é ~*"))), "a=%C3%A9+%7E*&b=x+y&c="), (urls.params_string(urls.params_delete(p, "a")), "b=x+y&c="), (urls.params_size(p), 4), (urls.params_has(p, "z"), False), (urls.params_keys(p), ["a", "b", "a", "c"]), (urls.resolved(F.lit("?q"), F.lit("HTTP://H/x#f")), "http://h/x?q"), (urls.resolved(F.lit("x")), None)])


def test_inline_style_and_hints(spark):
    style = "Color: red; color: blue ! important; background: url(data:image/png;base64,AA==); content: 'a;b'; --X: 1; broken; :none; width:"
    pairs = spark.range(1).select(css.inline_declarations(F.lit(style)).alias("p")).first().p
    assert [tuple(x) for x in pairs] == [("color", "red"), ("color", "blue"), ("background", "url(data:image/png;base64,AA==)"), ("content", "'a;b'"), ("--X", "1")]
    nodes = parse_pages(spark.createDataFrame([(1, '<table width=5 bgcolor=red><tr><td align=left style="color:a;color:b">x</table><p width=9>')], "page_id long, html string")).cache()
    got = {(r.tag, r.property, r.value) for r in css.computed_style(nodes, "td { text-align: right }").join(nodes.select("doc_id", "node_id", "tag"), ["doc_id", "node_id"]).collect()}
    assert got >= {("table", "width", "5px"), ("table", "background-color", "red"), ("td", "text-align", "right"), ("td", "color", "b")} and not any(t == "p" for t, _, _ in got)
    assert nodes.where("tag = 'td'").select(dom.style(F.col("attr_map")).alias("s")).first().s == {"color": "b"}


def test_constraint_error_whatever_is_read(spark):
    frame = lambda rows: spark.createDataFrame(rows, storage.SCHEMA)
    both = storage.add(frame([("d", "s", 1, "a", "1")]), frame([("d", "s", 9, "a", "9")]))
    for read in (both.count, lambda: both.select("value").collect(), both.collect):
        with pytest.raises(Exception, match="ConstraintError"):
            read()
    local = storage.set_item(frame([]), spark.createDataFrame([("o", 1, "k", "v"), ("o", 2, "l", "w"), ("o", 3, "k", "x")], "db string, seq long, key string, value string"))
    assert storage.get_item(local, "o", "k").first().value == "x" and storage.key_at(local, "o", 0).count() == 1 and storage.key_at(local, "o", 5).count() == 0
    assert storage.remove_item(local, "o", "k").count() == 1


def test_crawl_order_is_fixed(spark):
    pages = [(f"http://h/{k}", [f"http://h/{k * 2}", f"http://h/{k * 2 + 1}"]) for k in range(1, 40)] + [("http://h/A", ["http://h/upper"]), ("http://h/a", ["http://h/lower"])]
    seeds = ["http://h/a", "http://h/A", "http://h/1", "http://h/3"]
    found = set()
    for n in (1, 3, 7):
        web = spark.createDataFrame(pages, "url string, page_links array<string>").repartition(n)
        start = spark.createDataFrame([(u,) for u in seeds], "url string").repartition(n)
        found.add(tuple((r.url, r.depth) for r in crawl.crawl(start, web, crawl.CrawlOptions(max_pages=9)).orderBy("ord").collect()))
    assert len(found) == 1 and next(iter(found))[0] == ("http://h/1", 0) and ("http://h/upper", 1) in next(iter(found))
    ordered = spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, ord int")
    assert [r.url for r in crawl.crawl(ordered, web, crawl.CrawlOptions(max_depth=0)).orderBy("ord").collect()] == ["http://h/a", "http://h/1", "http://h/3"]


def test_search_options():
    assert search.flags_of("web", "web") == search.flags_of("duckduckgo", "brave", "mojeek") and search.flags_of("all") == (1 << 14) - 1
    with pytest.raises(ValueError, match="no such option"):
        search.options(depth=1)
    assert js.NAN != js.NAN


def test_sinks(spark, tmp_path, capsys):
    from pageloom.operators import sinks

    rows = spark.createDataFrame([("d", "s", 1, "a", "1"), ("d", "t/2", 2, "b", None), ("e", "s", 3, "c", "é")], storage.SCHEMA)
    sinks.write_nowhere(rows)
    sinks.write_console(rows.orderBy("seq"), 1)
    assert capsys.readouterr().out.strip() == '{"db":"d","store":"s","seq":1,"key":"a","value":"1"}'
    sinks.save_store(rows, str(tmp_path / "store"))
    assert sorted(sinks.load_store(spark, str(tmp_path / "store")).collect()) == sorted(rows.collect())
    seen, ends = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    sinks.for_each_record(rows.repartition(2), lambda r: seen.add(r.seq), end=lambda: ends.add(1))
    assert seen.value == 6 and ends.value == 2
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("a long").json(str(tmp_path / "in"))
    (tmp_path / "in" / "x.json").write_text('{"a": 5}\n')
    got = []
    sinks.stream_to(stream, lambda batch, n: got.extend((n, r.a) for r in batch.collect()), str(tmp_path / "check")).awaitTermination(60)
    assert got == [(0, 5)]
