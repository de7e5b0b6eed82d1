"""Usage analytics over a log of calls and a table of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(usage: DataFrame, top: int, account: Column | None = None) -> DataFrame:
    """The latest calls (of the rows that `account` selects): a top-k, so no full sort."""
    rows = usage if account is None else usage.where(account)
    return rows.orderBy(F.col("ts").desc(), F.col("event_id")).limit(top)


def by_key(usage: DataFrame, key: str = "key_id", ts: str = "ts") -> DataFrame:
    """calls and last_call of each key; combined before the shuffle."""
    return usage.groupBy(key).agg(F.count("*").alias("calls"), F.max(ts).alias("last_call"))


def keys_with_usage(keys: DataFrame, usage: DataFrame, key: str, usage_key: str) -> DataFrame:
    """Every key with its calls, 0 if it has none."""
    used = by_key(usage, usage_key).withColumnRenamed(usage_key, "__key")
    return keys.join(used, keys[key] == F.col("__key"), "left").drop("__key").withColumn("calls", F.coalesce("calls", F.lit(0).cast("long")))


def active_keys(keys: DataFrame, now: Column) -> DataFrame:
    return keys.agg(F.count_if(~F.col("is_revoked") & (F.col("expires").isNull() | (F.col("expires") > now))).alias("active"))


def live_keys(keys: DataFrame, account: str, user: str) -> DataFrame:
    return keys.where((F.col("account_id") == account) & (F.col("user_id") == user) & ~F.col("is_revoked")).orderBy(F.col("created").desc())


def key_by_hash(keys: DataFrame, token_hash: str) -> DataFrame:
    return keys.where((F.col("token_hash") == token_hash) & ~F.col("is_revoked")).limit(1)


def today(usage: DataFrame, now: Column) -> DataFrame:
    return usage.agg(F.count_if(F.col("ts") >= F.date_trunc("day", now)).alias("calls_today"))


def latency_of_latest(usage: DataFrame, rows: int = 100) -> DataFrame:
    """The mean duration of the latest calls, cut to a whole number; 0 without calls."""
    return recent(usage, rows).agg(F.coalesce(F.avg("duration_ms"), F.lit(0.0)).cast("int").alias("avg_latency"))


def status_bucket(status: Column) -> Column:
    return F.when(status.between(200, 299), "2xx").when(status.between(400, 499), "4xx").otherwise("other")


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / float(1 << 20)))
