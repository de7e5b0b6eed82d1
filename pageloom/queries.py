"""The registered queries of the web-document engine and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import js, urls
from pageloom.operators import crawl as crawling
from pageloom.operators import search, usage
from pageloom.operators.article import skim
from pageloom.operators.selections import selections
from pageloom.plans import selectors
from pageloom.plans.checkpoints import ensure_checkpoint_dir, written
from pageloom.sources.pages import parse_pages
from pageloom.streaming import events as windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table, written once, so that the query's joins parse no page twice and filters reach the scan."""
    return written(parse_pages(_t(spark, d, "pages")), "nodes")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_UNESCAPED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TITLE = "regexp_replace(" + _UNESCAPED.format("regexp_extract(html, '<title>(.*?)</title>', 1)") + r", '^\s+|\s+$', '', 'g')"

# --- parsing, selectors, extraction ---


@query(f"select page_id, {_TITLE} as title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::bigint as n_links from pages")
def page_titles(spark, d):
    """The flagship: title and number of links of every page, over the node table."""
    nodes = _nodes(spark, d)
    titles = selectors.text_content(nodes, selectors.select_first(nodes, "title")).select("doc_id", js.trim(F.col("text")).alias("title"))
    links = selectors.select_all(nodes, "a[href]").groupBy("doc_id").agg(F.count("*").alias("n_links"))
    return _t(spark, d, "pages").select("page_id").join(titles, F.col("page_id") == titles["doc_id"], "left").drop("doc_id").join(links, F.col("page_id") == links["doc_id"], "left").select("page_id", "title", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


@query("select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages")
def page_links(spark, d):
    return selectors.select_all(_nodes(spark, d), "a[href]").select(F.col("doc_id").alias("page_id"), F.element_at("attr_map", "href").alias("href"))


@query("select page_id, len(regexp_extract_all(split_part(html, '</nav>', 1), '<li>'))::bigint as n from pages where contains(html, '<li>')")
def css_child(spark, d):
    return selectors.select_all(_nodes(spark, d), "nav > ul > li").groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))


@query("select page_id, len(regexp_extract_all(split_part(html, '<article>', 2), '<p>'))::bigint as n from pages where len(regexp_extract_all(split_part(html, '<article>', 2), '<p>')) > 0")
def css_descendant(spark, d):
    return selectors.select_all(_nodes(spark, d), "body article p").groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[2] as href from pages where len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) > 1")
def css_nth(spark, d):
    return selectors.select_all(_nodes(spark, d), "nav li:nth-child(2) > a").select(F.col("doc_id").alias("page_id"), F.element_at("attr_map", "href").alias("href"))


@query("select page_id, (len(regexp_extract_all(html, '<li>')) - 1)::bigint as n from pages where len(regexp_extract_all(html, '<li>')) > 1")
def css_not(spark, d):
    return selectors.select_all(_nodes(spark, d), "nav li:not(:first-child)").groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))


@query("select page_id from pages where contains(html, '<article><h1>')")
def css_has(spark, d):
    return selectors.select_all(_nodes(spark, d), "article:has(h1)").select(F.col("doc_id").alias("page_id"))


@query("select page_id, " + _UNESCAPED.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)") + " as ad from pages where contains(html, '<div class=\"ad\">')")
def css_class_text(spark, d):
    nodes = _nodes(spark, d)
    return selectors.text_content(nodes, selectors.select_all(nodes, "div.ad")).select(F.col("doc_id").alias("page_id"), F.col("text").alias("ad"))


@query("select page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang from pages")
def css_root_attribute(spark, d):
    return selectors.select_all(_nodes(spark, d), "html:root[lang]").select(F.col("doc_id").alias("page_id"), F.element_at("attr_map", "lang").alias("lang"))


@query("select page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang, regexp_extract(url, '^https?://([^/:?#]+)', 1) as site_name, " + _TITLE + " as title from pages")
def article_metadata(spark, d):
    return skim(_t(spark, d, "pages")).select("page_id", "lang", "site_name", "title")


@query("select page_id, len(regexp_extract_all(html, '<li>'))::int as n_items, len(regexp_extract_all(html, '<h1>'))::int as n_heads from pages")
def page_selections(spark, d):
    """The crawl's selector projection: matches and their texts, in the same hop as parsing."""
    chosen = selections(_t(spark, d, "pages"), ["nav li", "h1"])
    count = lambda k: F.col("selections")[k]["match_count"]
    return chosen.select("page_id", count(0).alias("n_items"), count(1).alias("n_heads"))


# --- URLs ---


@query(r"""select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as hostname, regexp_extract(url, '^(https?:)', 1) as protocol,
case when regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) end as pathname,
regexp_extract(url, '(\?[^#]*)', 1) as search, regexp_extract(url, '(#.*)$', 1) as hash from pages""")
def url_parts(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.hostname(u).alias("hostname"), urls.protocol(u).alias("protocol"), urls.pathname(u).alias("pathname"), urls.search(u).alias("search"), urls.hash_(u).alias("hash"))


@query(r"select page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) as page from pages where regexp_matches(url, '[?&]page=')")
def url_params(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.param_get(F.col("url"), "page").alias("page")).where("page is not null")


@query(r"""with hits as (select page_id, url, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '')) as k, 0 as o from pages
union all select page_id + 1000000, upper(url), lower(regexp_replace(regexp_replace(upper(url), '#.*$', ''), '/$', '')), 1 from pages)
select page_id, url from (select *, row_number() over (partition by k order by o, page_id) as rn from hits) where rn = 1""")
def search_merge_first(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url")
    hits = p.withColumn("o", F.lit(0)).union(p.select(F.col("page_id") + 1000000, F.upper("url"), F.lit(1)))
    return search.merge_first(hits, [F.col("o"), F.col("page_id")]).select("page_id", "url")


@query("select lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, count(*) as pages, max(length(html))::bigint as longest from pages group by 1")
def host_stats(spark, d):
    return _t(spark, d, "pages").groupBy(urls.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.max(F.length("html")).cast("long").alias("longest"))


@query()
def crawl_levels(spark, d):
    """A crawl over the pages themselves, whose links are made to lead from each page to others of the table."""
    ensure_checkpoint_dir(spark)
    p = _t(spark, d, "pages").select("page_id", "url")
    return crawling.crawl(p.where("page_id = 0").select("url"), _web(p), crawling.CrawlOptions(max_pages=40, max_depth=4, stay_on_host=False)).select("url", "depth", "ord")


def _web(p: DataFrame) -> DataFrame:
    """Each page links to the pages numbered 2k + 1 and 2k + 2."""
    edges = p.select(F.floor((F.col("page_id") - 1) / 2).alias("page_id"), F.col("url").alias("to"), F.col("page_id").alias("n")).where("n > 0")
    out = edges.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", "to"))).alias("l")).select("page_id", F.transform("l", lambda x: x["to"]).alias("page_links"))
    return p.join(out, "page_id", "left").select("url", F.coalesce("page_links", F.array().cast("array<string>")).alias("page_links"))


ORACLES["crawl_levels"] = r"""with recursive p as (select page_id, regexp_replace(url, '#.*$', '') as url from pages),
r as (select page_id, url, 0 as depth from p where page_id = 0
union all select p.page_id, p.url, r.depth + 1 from r join p on p.page_id in (2 * r.page_id + 1, 2 * r.page_id + 2) where r.depth < 4)
select url, depth::int as depth, row_number() over (order by depth, page_id) as ord from r qualify ord <= 40"""

# --- usage analytics ---


@query("select event_id, user_id, ts from events order by ts desc, event_id limit 50")
def usage_recent(spark, d):
    return usage.recent(_t(spark, d, "events"), 50).select("event_id", "user_id", "ts")


@query("select user_id, count(*) as calls, max(ts) as last_call from events group by 1")
def usage_by_key(spark, d):
    return usage.by_key(_t(spark, d, "events"), "user_id")


@query("select c_custkey, c_name, coalesce(calls, 0)::bigint as calls, last_call from customer left join (select user_id, count(*) as calls, max(ts) as last_call from events group by 1) on c_custkey = user_id")
def usage_left_join(spark, d):
    return usage.keys_with_usage(_t(spark, d, "customer").select("c_custkey", "c_name"), _t(spark, d, "events"), "c_custkey", "user_id")


@query("select case when event_id % 600 between 200 and 299 then '2xx' when event_id % 600 between 400 and 499 then '4xx' else 'other' end as bucket, count(*) as n from events group by 1")
def usage_status_bucket(spark, d):
    return _t(spark, d, "events").groupBy(usage.status_bucket(F.col("event_id") % 600).alias("bucket")).agg(F.count("*").alias("n"))


@query("select event_type, count(distinct user_id) as users from events group by 1")
def usage_distinct(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("select count(*) as calls_today from events where ts >= timestamp '2024-01-15'")
def usage_today(spark, d):
    return usage.today(_t(spark, d, "events"), F.lit("2024-01-15 10:00:00").cast("timestamp"))


@query("select sum(octet_length(encode(html)))::bigint as total_bytes from pages")
def crawl_bytes(spark, d):
    return _t(spark, d, "pages").agg(F.sum(F.octet_length("html")).alias("total_bytes"))


# --- the function library ---


@query(r"""select doc_id, text[1:1] as first, text[-5:] as last5, coalesce(nullif(strpos(text, 'the'), 0) - 1, -1)::int as at_the, md5(lower(text)) as low, contains(text, 'and') as has_and,
md5(case when length(text) >= 12 then text else lpad(text, 12, '*') end) as padded, md5(replace(text, 'e', 'E')) as replaced, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> ''))::int as words from documents""")
def js_strings(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", js.char_at(t, 0).alias("first"), js.slice_(t, -5).alias("last5"), js.index_of(t, "the").alias("at_the"), F.md5(F.lower(t)).alias("low"), js.includes(t, "and").alias("has_and"), F.md5(js.pad_start(t, 12, "*")).alias("padded"), F.md5(js.replace_all(t, "e", "E")).alias("replaced"), F.size(F.filter(F.split(t, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")).alias("words"))


@query(r"""select doc_id, base64(encode('id ' || doc_id)) as b64, md5(text) as md5, sha256(text) as sha256, string_split(text, ' ')[1:3] as head, len(string_split(text, ' '))::int as parts, regexp_extract_all(text, '[0-9]+') as numbers from documents""")
def js_encodings(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", js.btoa(F.concat(F.lit("id "), F.col("doc_id").cast("string"))).alias("b64"), F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), js.split(t, " ", 3).alias("head"), F.size(js.split(t, " ")).alias("parts"), js.match_all(t, "[0-9]+").alias("numbers"))


@query("""select l_orderkey, l_linenumber, floor(l_quantity + 0.5)::double as rounded, (l_quantity::int & 12)::int as anded, (l_quantity::int << 3)::int as shifted, sign(l_extendedprice - 30000)::double as sgn,
least(l_quantity, l_tax * 100) as low, fmod(l_extendedprice, 7.0) as rest, cast(l_discount as decimal(38,2))::varchar as fixed from lineitem""")
def js_math(spark, d):
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", js.round_(q).alias("rounded"), js.bit_and(q, F.lit(12)).alias("anded"), js.shift_left(q, 3).alias("shifted"), F.signum(e - 30000).alias("sgn"), js.min_(q, F.col("l_tax") * 100).alias("low"), js.remainder(e, F.lit(7.0)).alias("rest"), js.to_fixed(F.col("l_discount"), 2).alias("fixed"))


@query("""select vec_id, len(list_filter(embedding, lambda x: x > 0))::int as positive, embedding[1] as first, embedding[-1] as last, list_bool_or(list_transform(embedding, lambda x: x > 0.5)) as some,
list_bool_and(list_transform(embedding, lambda x: x < 5)) as every, embedding[3:5] as part, list_reverse(embedding)[1:2] as back, (list_position(embedding, embedding[4]) - 1)::bigint as at from embeddings""")
def js_arrays(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0)).alias("positive"), js.array_at(e, 0).alias("first"), js.array_at(e, -1).alias("last"), F.exists(e, lambda x: x > 0.5).alias("some"), F.forall(e, lambda x: x < 5).alias("every"), js.array_slice(e, 2, 5).alias("part"), js.array_slice(F.reverse(e), 0, 2).alias("back"), js.array_index_of(e, F.get(e, F.lit(3))).alias("at"))


@query("""select o_orderkey, year(o_orderdate)::int as full_year, (month(o_orderdate) - 1)::int as month, day(o_orderdate)::int as date, dayofweek(o_orderdate)::int as day, epoch_ms(o_orderdate)::bigint as time,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') as iso from orders""")
def js_dates(spark, d):
    p = js.date_parts(F.col("o_orderdate"))
    return _t(spark, d, "orders").select("o_orderkey", *(p[k].alias(k) for k in ("full_year", "month", "date", "day", "time")), js.iso_string(F.col("o_orderdate")).alias("iso"))


@query("select event_id, json_keys(props)[1] as key, (props ->> ('$.' || json_keys(props)[1]))::double as value from events")
def js_json(spark, d):
    m = F.from_json("props", "map<string,double>")
    return _t(spark, d, "events").select("event_id", F.get(F.map_keys(m), F.lit(0)).alias("key"), F.get(F.map_values(m), F.lit(0)).alias("value"))


@query(r"select doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ +| +$', '', 'g') as collapsed from documents")
def text_collapse(spark, d):
    return _t(spark, d, "documents").select("doc_id", js.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("collapsed"))


@query("select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles from conversations group by 1")
def ordered_join(spark, d):
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r")).select("conv_id", "turns", js.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unlabelled(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left_anti")


# --- windows on events (an extension) ---


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, count(value) as n_values from events group by 1, 2")
def events_tumbling(spark, d):
    return windows.tumbling(_t(spark, d, "events"))


@query("""select w as window_start, event_type, count(*) as n, count(value) as n_values from (select *, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as w from events) group by 1, 2""")
def events_sliding(spark, d):
    return windows.tumbling(_t(spark, d, "events"), slide="30 minutes")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as s from events),
n as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from n group by user_id, k""")
def events_session(spark, d):
    return windows.sessions(_t(spark, d, "events"))
