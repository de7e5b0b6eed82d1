"""Key-value stores as tables (db, store, seq, key, value): the reads and writes of a small browser database.

Writes return the new table; the caller writes it out. seq is the order of insertion, which scans keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "db string, store string, seq long, key string, value string"
_KEY = ["db", "store", "key"]


def _last(rows: DataFrame) -> DataFrame:
    """The last row written of each key."""
    return rows.groupBy(*_KEY).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")).select("db", "store", "seq", "key", "value")


def put(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert: a key that is there keeps its place and takes the new value."""
    new, old = _last(rows).alias("n"), table.alias("o")
    joined = old.join(new, _KEY, "full_outer")
    return joined.select("db", "store", F.coalesce("o.seq", "n.seq").alias("seq"), "key", F.when(F.col("n.seq").isNotNull(), F.col("n.value")).otherwise(F.col("o.value")).alias("value"))


def add(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert: a key that is there already, or twice in rows, is a constraint error when the result is computed."""
    doubled = rows.unionByName(table.join(rows.select(*_KEY).distinct(), _KEY, "left_semi").select("db", "store", "seq", "key", "value"))
    checked = doubled.groupBy(*_KEY).agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("seq").alias("seq"))
    fault = F.raise_error(F.concat(F.lit("ConstraintError: "), F.col("key")))
    # the check is a filter, which stays whatever columns are read
    fresh = checked.where(F.when(F.col("n") > 1, fault.cast("boolean")).otherwise(True))
    return table.unionByName(fresh.select("db", "store", "seq", "key", "value"))


def _in(db: str, store: str) -> Column:
    return (F.col("db") == db) & (F.col("store") == store)


def get(table: DataFrame, db: str, store: str, key: str) -> DataFrame:
    return table.where(_in(db, store) & (F.col("key") == key)).select("value")


def delete(table: DataFrame, db: str, store: str, key: str) -> DataFrame:
    return table.where(~(_in(db, store) & (F.col("key") == key)))


def clear(table: DataFrame, db: str, store: str) -> DataFrame:
    return table.where(~_in(db, store))


def count(table: DataFrame, db: str, store: str) -> DataFrame:
    return table.where(_in(db, store)).agg(F.count("*").alias("n"))


def get_all(table: DataFrame, db: str, store: str) -> DataFrame:
    return table.where(_in(db, store)).orderBy("seq").select("key", "value")


def get_all_keys(table: DataFrame, db: str, store: str) -> DataFrame:
    return get_all(table, db, store).select("key")


delete_store = clear


# --- a store of plain texts, such as a page's local storage: db is the origin ---

LOCAL = "local"


def set_item(table: DataFrame, items: DataFrame) -> DataFrame:
    """items: db, seq, key, value."""
    return put(table, items.withColumn("store", F.lit(LOCAL)).select("db", "store", "seq", "key", "value"))


def get_item(table: DataFrame, origin: str, key: str) -> DataFrame:
    return get(table, origin, LOCAL, key)


def remove_item(table: DataFrame, origin: str, key: str) -> DataFrame:
    return delete(table, origin, LOCAL, key)


def key_at(table: DataFrame, origin: str, n: int) -> DataFrame:
    """The key of the n-th item by insertion: a top-k of n + 1 rows."""
    return get_all_keys(table, origin, LOCAL).offset(n).limit(1)

