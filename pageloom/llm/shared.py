"""Helpers that several corpus operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 50_000
#: Rows of one key from which they are joined apart, at least.
HOT = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (all in one
    process) gets a temporary folder; a cluster gets an error, as its machines have no folder in common then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pageloom-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def tables_dir(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_dir(spark)}/pageloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Removes this application's tables; DataFrames that still read them cannot be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (already written) with a broadcast hint if its counted rows are few enough, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def met(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with a written table of one row for each key, whose column `count` says how many rows have the key.

    Keys of many rows are joined apart: at most BROADCAST_ROWS keys can have more than a BROADCAST_ROWS-th of all rows, so
    that side may be broadcast, and no task gets a whole large group.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first().n
    hot = F.col(count) > max(HOT, total // BROADCAST_ROWS)
    many = F.broadcast(table.where(hot))
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(table.where(~hot), key))


def met_left(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows left joined with a written table of one row for each text key, whose column `count` (left out of the result)
    says how many rows have the key; keys of many rows must be in it. A small table is broadcast; of others the keys of
    many rows are, and the rows that have met them are spread evenly in the second join."""
    totals = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"), F.count("*").alias("keys")).first()
    own = [c for c in table.columns if c not in (key, count)]
    if totals.keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(count)), key, "left")
    hot = F.col(count) > max(HOT, totals.n // BROADCAST_ROWS)
    part = lambda where, mark: table.where(where).select(F.col(key).alias(f"__{mark}"), *(F.col(c).alias(f"__{mark}_{c}") for c in own))
    one = rows.join(F.broadcast(part(hot, "hot")), F.col(key) == F.col("__hot"), "left")
    salt = F.concat(key, F.lit("/"), F.pmod(F.xxhash64(*(c for c, k in rows.dtypes if k in ("bigint", "int", "string"))), F.lit(4096)).cast("string"))
    both = one.join(part(~hot, "rest"), F.when(F.col("__hot").isNull(), F.col(key)).otherwise(salt) == F.col("__rest"), "left")
    return both.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__rest_{c}").alias(c) for c in own))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text (whole) and y of at most `rows` labelled documents, by the order of a hash of their id.

    The labels are sampled first, so the broadcast side has `rows` rows at most. Rows of one id count as one, with the
    least text and label; rows with a null id, label or text are left out.
    """
    picked = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id").agg(F.min("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return got.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
