"""A bounded crawl as iterative joins: each level of the frontier is joined with the source of pages once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.urls import crawl_key, hostname, without_fragment


@dataclass
class CrawlOptions:
    max_pages: int = 100
    max_depth: int = 2
    stay_on_host: bool = True
    follow_links: bool = True
    url_filter: Column | None = None


def crawl(seeds: DataFrame, pages: DataFrame, options: CrawlOptions | None = None) -> DataFrame:
    """key, url, depth, ord of the pages reached from seeds (url) in breadth-first order.

    pages: url, page_links (array of absolute URLs), as `article.skim(..., all_links=True)` gives them, and
    optionally error (a page with an error is reached but not followed). seeds are taken in the order of a column `ord`, or
    else of their URLs. The order (depth, order of the parent, order of its links) is fixed, so the cap on pages always
    takes the same ones. Levels are cut by checkpoint().
    """
    o = options or CrawlOptions()
    web = pages.select(crawl_key(F.col("url")).alias("key"), "url", "page_links", (F.col("error") if "error" in pages.columns else F.lit(None).cast("string")).alias("error"))
    # of pages that differ in case only, the first by URL
    web = web.groupBy("key").agg(F.min_by(F.struct("page_links", "error"), F.struct("url", F.xxhash64("page_links"))).alias("p")).select("key", "p.*")
    start = seeds.select("url", (F.col("ord") if "ord" in seeds.columns else F.col("url")).alias("ord")).where(F.lower("url").rlike("^https?://"))
    hosts = start.select(hostname(F.col("url")).alias("host")).distinct()
    level = _first(start.withColumn("key", crawl_key(F.col("url"))))
    level = level.select("key", without_fragment(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("ord")).cast("long").alias("ord")).where(F.col("ord") <= o.max_pages).checkpoint()
    reached, count = level, level.count()
    for depth in range(1, o.max_depth + 1 if o.follow_links else 1):
        if count >= o.max_pages:
            break
        found = level.join(web.where(F.col("error").isNull()), "key").select("ord", F.posexplode("page_links").alias("pos", "url"))
        found = found.where(F.lower("url").rlike("^https?://")).withColumn("key", crawl_key(F.col("url")))
        if o.stay_on_host:
            found = found.withColumn("host", hostname(F.col("url"))).join(hosts, "host", "left_semi")
        if o.url_filter is not None:
            found = found.where(o.url_filter)
        new = _first(found.withColumn("ord", F.struct("ord", "pos"))).join(reached, "key", "left_anti")
        # the cap bounds what is numbered in one window: at most max_pages rows pass the top-k
        top = new.orderBy("ord").limit(o.max_pages - count)
        level = top.select("key", without_fragment(F.col("url")).alias("url"), F.lit(depth).alias("depth"), (F.row_number().over(Window.orderBy("ord")) + count).cast("long").alias("ord")).checkpoint()
        size = level.count()
        if not size:
            break
        reached, count = reached.unionByName(level), count + size
    return reached


def with_pages(crawled: DataFrame, pages: DataFrame) -> DataFrame:
    """The crawl's rows with what was found there: page columns under `page`, and error (`not found` where there is none)."""
    own = pages.select(crawl_key(F.col("url")).alias("key"), F.struct(*pages.columns).alias("page"), F.lit(True).alias("there"))
    own = own.groupBy("key").agg(F.min_by("page", "page.url").alias("page"), F.first("there").alias("there"))
    joined = crawled.join(own, "key", "left")
    error = F.when(F.col("there").isNull(), F.lit("not found"))
    error = F.coalesce(error, F.col("page.error")) if "error" in pages.columns else error
    return joined.select(*crawled.columns, "page", error.alias("error"))


def polite_schedule(frontier: DataFrame, delay_ms: int = 250) -> DataFrame:
    """frontier (url, ord) with host and start_ms: one request at a time for each host, `delay_ms` apart at least."""
    hosted = frontier.withColumn("host", hostname(F.col("url")))
    return hosted.withColumn("start_ms", (F.row_number().over(Window.partitionBy("host").orderBy("ord")) - 1).cast("long") * delay_ms)


def _first(rows: DataFrame) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy("key").agg(F.min(F.struct("ord", "url")).alias("f")).select("key", F.col("f.ord").alias("ord"), F.col("f.url").alias("url"))
