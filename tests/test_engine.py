"""Crawl, search, usage and streaming on small tables, and every registered query against its oracle."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pageloom import catalog
from pageloom.operators import crawl, search, usage
from pageloom.plans.checkpoints import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_crawl(spark):
    ensure_checkpoint_dir(spark)
    web = [("http://h/a", ["http://h/b#x", "http://H/B", "http://o/z", "http://h/c"], None), ("http://h/b", ["http://h/d", "http://h/a"], None), ("http://h/c", ["http://h/e"], "bad"), ("http://h/d", ["http://h/f"], None)]
    pages = spark.createDataFrame(web, "url string, page_links array<string>, error string")
    seeds = spark.createDataFrame([("http://h/a",), ("ftp://h/x",)], "url string")
    run = lambda **kw: [(r.url, r.depth) for r in crawl.crawl(seeds, pages, crawl.CrawlOptions(**kw)).orderBy("ord").collect()]
    assert run() == [("http://h/a", 0), ("http://h/b", 1), ("http://h/c", 1), ("http://h/d", 2)]
    assert run(max_pages=2) == [("http://h/a", 0), ("http://h/b", 1)] and run(follow_links=False) == [("http://h/a", 0)]
    assert ("http://o/z", 1) in run(stay_on_host=False) and run(max_depth=3)[-1] == ("http://h/f", 3)


def test_search(spark):
    payloads = [("github", '{"items":[{"html_url":"http://g/1","full_name":"r","stargazers_count":5},{"full_name":"no url"}]}'), ("wikipedia", '["q",["T"],["S"],["http://w/T"]]'), ("reddit", '{"data":{"children":[{"data":{"permalink":"/r/x","title":"R"}}]}}'), ("hackernews", "broken"), ("crossref", '{"message":{"items":[{"DOI":"10.1/x","title":["C"],"container-title":["J"]}]}}')]
    df = spark.createDataFrame(payloads, "provider string, payload string")
    every = sum(search.FLAGS.values())
    hits = search.fan_in(df, every)
    got = {r.source: (r.url, r.title) for r in hits.collect()}
    assert got == {"github": ("http://g/1", "r"), "wikipedia": ("http://w/T", "T"), "reddit": ("https://www.reddit.com/r/x", "R"), "crossref": ("https://doi.org/10.1/x", "C")}
    assert {r.source for r in search.fan_in(df, search.FLAGS["github"]).collect()} == {"github"}
    twice = hits.union(hits.withColumn("url", F.upper("url")).withColumn("rank", F.lit(9)))
    merged = search.merge_first(twice, [search.provider_order(F.col("source")), F.col("rank")])
    assert merged.count() == 4 and merged.where("rank = 9").count() == 0
    crawled = spark.createDataFrame([("http://G/1/",), ("http://none/",)], "requested_url string")
    assert {r.requested_url: r.search is not None for r in search.reattach(crawled, hits).collect()} == {"http://G/1/": True, "http://none/": False}
    assert search.clamp(None, 10, 1, 50) == 10 and search.clamp(99, 10, 1, 50) == 50


def test_usage(spark):
    keys = spark.createDataFrame([("a", False, None), ("b", True, None), ("c", False, "2020-01-01 00:00:00")], "id string, is_revoked boolean, expires string").withColumn("expires", F.to_timestamp("expires"))
    assert usage.active_keys(keys, F.lit("2024-01-01").cast("timestamp")).first().active == 1
    calls = spark.createDataFrame([(1, "a", 10), (2, "a", 21)], "event_id int, key_id string, duration_ms int").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    assert {r.id: r.calls for r in usage.keys_with_usage(keys, calls, "id", "key_id").collect()} == {"a": 2, "b": 0, "c": 0}
    assert usage.latency_of_latest(calls).first().avg_latency == 15 and usage.latency_of_latest(calls.where("false")).first().avg_latency == 0
    assert [r.v for r in spark.createDataFrame([(500,), (2048,), (3 << 20,)], "n long").select(usage.bytes_text(F.col("n")).alias("v")).collect()] == ["500 B", "2.0 KB", "3.0 MB"]


def test_streams_equal_tables(spark, tmp_path):
    from pageloom.streaming import events as windows

    table = spark.read.parquet(f"{SF}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, windows.tumbling(table).collect()))


def plain(v):
    """A value as both engines mean it: numbers to nine digits, NaN as absent, arrays as lists."""
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer part orders lineitem events documents embeddings pages labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, duck, name):
    want = duck.execute(catalog.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    rows = sorted(repr([plain(dict(zip((c[0] for c in want.description), r, strict=True))[c]) for c in columns]) for r in want.fetchall())
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() == 50 and set(entry.oracle_sql()) <= set(entry.queries())
