"""Search fan-in: canned payloads of many providers become one list of hits, first one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.urls import search_key

# Providers by bit, in order, and the bundles.
PROVIDERS = ("wikipedia", "arxiv", "github", "hackernews", "stackexchange", "crossref", "openlibrary", "reddit", "duckduckgo", "brave", "mojeek", "gdelt", "guardian", "bingnews")
FLAGS = {name: 1 << k for k, name in enumerate(PROVIDERS)}
#: The bundles of providers.
BUNDLES = {"web": ("duckduckgo", "brave", "mojeek"), "news": ("gdelt", "guardian", "bingnews"), "scholarly": ("wikipedia", "arxiv", "crossref", "openlibrary"), "community": ("github", "hackernews", "stackexchange", "reddit"), "all": PROVIDERS}
#: Default, least and greatest of each option.
LIMITS = {"per_provider": (10, 1, 50), "max_crawled": (20, 1, 200), "max_depth": (0, 0, 5), "max_pages": (50, 1, 500), "parallel": (8, 1, 32)}
HIT = "source string, rank int, url string, title string, snippet string, extra map<string,string>"

# For each JSON provider the path to its items, the items' schema, and the hit's expressions.
JSON = {
    "github": ("items", "html_url string, full_name string, description string, stargazers_count long, language string", "i.html_url", "i.full_name", "i.description", {"stars": "i.stargazers_count", "language": "i.language"}),
    "hackernews": ("hits", "objectID string, url string, title string, points long, num_comments long, author string", "coalesce(i.url, concat('https://news.ycombinator.com/item?id=', i.objectID))", "i.title", "null", {"points": "i.points", "comments": "i.num_comments", "author": "i.author"}),
    "stackexchange": ("items", "link string, title string, score long, answer_count long, is_answered boolean", "i.link", "i.title", "null", {"score": "i.score", "answers": "i.answer_count", "answered": "i.is_answered"}),
    "crossref": ("message.items", "URL string, DOI string, title array<string>, `container-title` array<string>", "coalesce(i.URL, concat('https://doi.org/', i.DOI))", "get(i.title, 0)", "null", {"doi": "i.DOI", "journal": "get(i.`container-title`, 0)"}),
    "openlibrary": ("docs", "key string, title string, author_name array<string>, first_publish_year long, edition_count long", "concat('https://openlibrary.org', i.key)", "i.title", "null", {"author": "array_join(i.author_name, '; ')", "firstPublishYear": "i.first_publish_year", "editions": "i.edition_count"}),
    "reddit": ("data.children", "data struct<permalink:string,title:string,selftext:string,score:long,num_comments:long,subreddit:string>", "concat('https://www.reddit.com', i.data.permalink)", "i.data.title", "i.data.selftext", {"score": "i.data.score", "comments": "i.data.num_comments", "subreddit": "i.data.subreddit"}),
    "gdelt": ("articles", "url string, title string, domain string, seendate string, language string, sourcecountry string", "i.url", "i.title", "null", {"domain": "i.domain", "seenDate": "i.seendate", "language": "i.language", "country": "i.sourcecountry"}),
    "guardian": ("response.results", "webUrl string, webTitle string, sectionName string, webPublicationDate string", "i.webUrl", "i.webTitle", "null", {"section": "i.sectionName", "publishedAt": "i.webPublicationDate"}),
}


def parse_json_hits(payloads: DataFrame, provider: str) -> DataFrame:
    """Hits of one JSON provider from payloads (provider, payload). A broken payload gives no hit."""
    rows = payloads.where(F.col("provider") == provider)
    if provider == "wikipedia":
        arrays = rows.select(F.expr("from_json(payload, 'array<string>')").alias("a"))
        each = arrays.select(F.posexplode(F.arrays_zip(*(F.from_json(F.get("a", F.lit(k)), "array<string>").alias(n) for k, n in ((1, "title"), (2, "snippet"), (3, "url"))))).alias("rank", "i"))
        return each.selectExpr(f"'{provider}' as source", "rank", "i.url as url", "i.title as title", "i.snippet as snippet", "cast(null as map<string,string>) as extra").where("url is not null")
    path, schema, url, title, snippet, extra = JSON[provider]
    items = rows.select(F.from_json(F.get_json_object("payload", f"$.{path}"), f"array<struct<{schema}>>").alias("items")).select(F.posexplode("items").alias("rank", "i"))
    pairs = ", ".join(f"'{k}', cast({v} as string)" for k, v in extra.items())
    return items.selectExpr(f"'{provider}' as source", "rank", f"{url} as url", f"{title} as title", f"cast({snippet} as string) as snippet", f"map_filter(map({pairs}), (k, v) -> v is not null) as extra").where("url is not null")


def fan_in(payloads: DataFrame, flags: int) -> DataFrame:
    """The hits of all providers that flags names, in one frame."""
    from pageloom.operators.search_markup import parse_markup_hits

    wanted = [p for p in PROVIDERS if flags & FLAGS[p]]
    parts = [parse_json_hits(payloads, p) for p in wanted if p in JSON or p == "wikipedia"]
    markup = [p for p in wanted if p not in JSON and p != "wikipedia"]
    if markup:
        parts.append(parse_markup_hits(payloads.where(F.col("provider").isin(*markup))))
    return reduce(DataFrame.unionByName, parts)


def provider_order(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PROVIDERS)), source)


def merge_first(hits: DataFrame, order: list[Column], key: Column | None = None) -> DataFrame:
    """One hit of each URL key: the first by `order`. An aggregate, combined before the shuffle, not a window."""
    key = search_key(F.col("url")) if key is None else key
    columns = hits.columns
    ranked = hits.select(key.alias("__key"), F.struct(*(c.alias(f"__o{k}") for k, c in enumerate(order))).alias("__o"), F.struct(*columns).alias("__row"))
    return ranked.groupBy("__key").agg(F.min_by("__row", "__o").alias("__row"), F.min("__o").alias("__o")).select("__row.*")


def top_seeds(hits: DataFrame, most: int, order: list[Column]) -> DataFrame:
    return hits.orderBy(*order).limit(most)


def reattach(crawled: DataFrame, hits: DataFrame, url: str = "requested_url") -> DataFrame:
    """Crawl results with the hit that led to them, if any."""
    h = hits.select(search_key(F.col("url")).alias("__key"), F.struct(*hits.columns).alias("search"))
    h = h.groupBy("__key").agg(F.min_by("search", F.struct(provider_order(F.col("search.source")), "search.rank")).alias("search"))
    return crawled.withColumn("__k", search_key(F.col(url))).join(h, F.col("__k") == F.col("__key"), "left").drop("__k", "__key")


def ranked(hits: DataFrame, order: list[Column], per: str) -> DataFrame:
    """rank of each hit within its source."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order)))


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def flags_of(*names: str) -> int:
    """The bits of providers and bundles by name."""
    out = 0
    for name in names:
        for provider in BUNDLES.get(name, (name,)):
            out |= FLAGS[provider]
    return out


def options(**given: int | None) -> dict[str, int]:
    """All options, each given one within its bounds."""
    unknown = set(given) - set(LIMITS)
    if unknown:
        raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
    return {name: clamp(given.get(name), *bounds) for name, bounds in LIMITS.items()}


def search(payloads: DataFrame, *providers: str, per_provider: int | None = None) -> DataFrame:
    """The hits of the named providers and bundles, the first of each address, in the order of providers."""
    most = options(per_provider=per_provider)["per_provider"]
    hits = fan_in(payloads, flags_of(*(providers or ("all",)))).where(F.col("rank") < most)
    return merge_first(hits, [provider_order(F.col("source")), F.col("rank")])


def search_and_crawl(payloads: DataFrame, pages: DataFrame, *providers: str, **given: int | None) -> DataFrame:
    """Searches, crawls from the first hits and gives the crawl's rows with page, error and the hit that led there."""
    from pageloom.operators import crawl

    o = options(**given)
    hits = search(payloads, *providers, per_provider=o["per_provider"])
    seeds = top_seeds(hits, o["max_crawled"], [provider_order(F.col("source")), F.col("rank"), F.col("url")])
    seeds = seeds.select("url", F.struct(provider_order(F.col("source")), "rank", "url").alias("ord"))
    crawled = crawl.crawl(seeds, pages, crawl.CrawlOptions(max_pages=o["max_pages"], max_depth=o["max_depth"], stay_on_host=True, follow_links=o["max_depth"] > 0))
    return reattach(crawl.with_pages(crawled, pages), hits, "url")
