"""Where records go besides JSON lines: a console, nowhere, a function of one's own, and the files of a key-value store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators import storage


def write_nowhere(records: DataFrame) -> None:
    """Computes all records and drops them."""
    records.write.format("noop").mode("overwrite").save()


def console_lines(records: DataFrame, most: int = 20) -> list[str]:
    """One line of JSON for each of the first records by all their columns' order: a top-k, not a collect of everything."""
    return [r.value for r in records.limit(most).selectExpr("to_json(struct(*)) as value").collect()]


def write_console(records: DataFrame, most: int = 20) -> None:
    for line in console_lines(records, most):
        print(line)


def for_each_record(records: DataFrame, handle: Callable[[Row], None], start: Callable[[], None] | None = None, end: Callable[[], None] | None = None) -> None:
    """Calls a function for each record where the record is; start and end once for each partition. A partition that is
    run again after a loss is handled again, so the function must bear repeats."""

    def run(rows: Iterator[Row]) -> None:
        if start:
            start()
        for row in rows:
            handle(row)
        if end:
            end()

    records.foreachPartition(run)


def stream_to(records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A sink of one's own for a stream: `write` gets each micro-batch with its number, which tells repeats."""
    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_store(table: DataFrame, path: str) -> None:
    """A key-value table as JSON lines in one folder for each database and store."""
    table.write.mode("overwrite").partitionBy("db", "store").json(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(storage.SCHEMA).json(path).select(*(c.strip().split(" ")[0] for c in storage.SCHEMA.split(",")))
