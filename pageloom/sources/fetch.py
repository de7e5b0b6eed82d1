"""Fetched pages as a table: synthetic answers, decoding, and the checks that a crawl makes before it parses.

No request leaves the cluster here: bodies come from a table or from files (`from_files`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BODY = 50 << 20


def from_files(spark: SparkSession, path: str, content_type: str | None = None) -> DataFrame:
    """url, status, content_type, body of the files under a path. One over the cap is a row of status 413 without a body,
    which the scan does not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lit(content_type).cast("string").alias("content_type")
    read = files.where(F.col("length") <= MAX_BODY).select(F.col("path").alias("url"), F.lit(200).alias("status"), kind, F.col("content").alias("body"))
    return read.unionByName(files.where(F.col("length") > MAX_BODY).select(F.col("path").alias("url"), F.lit(413).alias("status"), kind, F.lit(None).cast("binary").alias("body")))


def intercept(fetched: DataFrame, mocks: DataFrame) -> DataFrame:
    """fetched (url, status, content_type, body) with the answers that mocks has for a URL in place of the real ones."""
    m = mocks.select(F.col("url").alias("m_url"), F.col("status").alias("m_status"), F.col("content_type").alias("m_type"), F.col("body").alias("m_body"))
    m = m.groupBy("m_url").agg(F.min_by(F.struct("m_status", "m_type", "m_body"), F.struct("m_status", "m_type", F.md5("m_body"))).alias("m")).select("m_url", "m.*")
    hit = F.col("m_url").isNotNull()
    return fetched.join(m, F.col("url") == F.col("m_url"), "left").select("url", F.when(hit, F.col("m_status")).otherwise(F.col("status")).alias("status"), F.when(hit, F.col("m_type")).otherwise(F.col("content_type")).alias("content_type"), F.when(hit, F.col("m_body")).otherwise(F.col("body")).alias("body"))


def is_html(content_type: Column, body: Column) -> Column:
    """By type, else by a first character "<" after white space and a byte order mark."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    by_type = t.contains("text/html") | t.contains("application/xhtml") | t.startswith("text/")
    start = F.upper(F.hex(F.substring(body, 1, 256)))
    return by_type | F.coalesce(start.rlike("^(EFBBBF)?(09|0A|0C|0D|20)*3C"), F.lit(False))


def page_errors(fetched: DataFrame) -> DataFrame:
    """fetched with error: why a row is not parsed, or null. Rows stay; a bad page never fails a job."""
    why = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(F.col("body").isNull() | (F.octet_length("body") == 0), "empty response").when(~is_html(F.col("content_type"), F.col("body")), "not HTML")
    return fetched.withColumn("error", why)
