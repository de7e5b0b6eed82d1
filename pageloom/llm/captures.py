"""WARC: archives of captures, and their index merged into globally ordered capture histories.

Pages are written as WARC 1.1 records into gzip-compressed archives by Spark's own writer, so any store that Spark
writes will do. Of equal payloads the largest id is a response and the others revisit it. Reading parses whole
archives record by record and makes the URL key of each; an archive gives an index run sorted by URL key and timestamp,
and runs are merged range by range with a loser tree. Pages have no time of capture, so their id stands for it.

Defined results: a null html is an empty payload, and payloads of any length are kept whole; a null url has no target
header and sorts first; rows with a null id are responses; rows that share payload and largest id are all responses;
repeated rows have a record each; equal keys and times go by id, then by archive and place; an empty table gives an
empty index; only page_id, url and html are read, so extra columns of any name do not clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.shared import met_left, tables_dir, written

#: Records and bytes (before compression) to an archive at most, and index rows to a merged range.
ARCHIVE_RECORDS, ARCHIVE_BYTES, RANGE_ROWS = 1000, 1 << 30, 100_000
#: Fixed value: the letters of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a payload: 20 bits are five hexadecimal digits or four letters."""
    digest = F.sha1(payload)
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letters = F.transform(groups, lambda v: F.concat(*(F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0))))
    return F.array_join(letters, "")


_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://(www\.)?")
_HOST = re.compile(r"[^/?]*")


def url_key(url: str | None) -> str:
    """A sort-friendly key: host labels reversed, then path and query; lower case, without scheme, www, fragment. An
    address that is missing has the empty key."""
    if not url:
        return ""
    u = _SCHEME.sub("", url.lower().partition("#")[0])
    host = _HOST.match(u)[0]
    labels = re.sub(r":(80|443)$", "", host).split(".")
    return ",".join(reversed(labels)) + ")" + u[len(host) :]


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """record: the text of one WARC record without its closing blank lines, for each page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload"))
    same = rows.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"), F.count("*").alias("copies")).where("low < top").select("digest", "top", "copies")
    rows = met_left(rows, written(same, "payloads"), "digest", "copies")
    revisit = F.col("top").isNotNull() & (F.col("page_id") < F.col("top")) & (F.col("bytes") >= least)
    revisit = F.coalesce(revisit, F.lit(False))
    end = F.lit("\r\n")
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), end, end)
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), end, F.lit("WARC-Record-ID: "), name(F.col("page_id")), end, F.lit("WARC-Date: "), at, end,
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), end)),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), end,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("top")), end)).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    return rows.select(F.concat(head, F.octet_length(block).cast("string"), end, end, block).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0, per_archive: int = ARCHIVE_RECORDS) -> None:
    """Archives of at most `per_archive` records, and of fewer where the longest payload could make one too large to read."""
    longest = pages.agg(F.max(F.octet_length("html")).alias("n")).first().n or 0
    per_archive = max(1, min(per_archive, ARCHIVE_BYTES // (longest + 4096)))
    records(pages, least).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_archive).text(path)


def parse_archive(packed: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes, int]]:
    """(headers, HTTP headers, payload, offset) of the records of a gzip-compressed archive, one by one.

    Lengths come from the records, so a payload may hold anything, also text that looks like a record.
    """
    engine, ready, at, base, given = zlib.decompressobj(31), bytearray(), 0, 0, 0
    step = 1 << 20

    def more() -> bool:
        nonlocal given, engine
        if given >= len(packed):
            return False
        ready.extend(engine.decompress(packed[given : given + step]))
        given += step
        while engine.eof and engine.unused_data:
            rest = engine.unused_data
            engine = zlib.decompressobj(31)
            ready.extend(engine.decompress(rest))
        return True

    while True:
        while (end := ready.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        lines = ready[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        start, size = end + 4, int(headers["Content-Length"])
        while len(ready) < start + size + 4 and more():
            pass
        block = bytes(ready[start : start + size])
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield headers, http, payload, base + at
        at = start + size + 4
        if at > step:
            del ready[:at]
            base, at = base + at, 0


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of the archives; each archive is one run, numbered in sorted order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for h, http, payload, offset in parse_archive(content):
                    kind = h["WARC-Type"]
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size, digest = int(http.rpartition(b"Content-Length: ")[2]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                    own, other = h["WARC-Record-ID"][13:-1], h.get("WARC-Refers-To", "<urn:capture:none>")[13:-1]
                    rows.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"], None if own == "none" else int(own), size, digest, kind, None if other == "none" else int(other), h.get("WARC-Target-URI"), name.rpartition("/")[2], offset))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
                out = pd.DataFrame(rows, columns=["url_key", "ts", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset"])
                out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
                out["run_no"] = range(len(out))
                yield out

    return files.mapInPandas(run, "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, run_no long")


def loser_tree(runs: list[list]) -> Iterator:
    """The entries of sorted runs in order. The inner nodes hold the losers of their matches; the winner is replaced
    by its run's next entry, which plays only the matches on its way to the top."""
    k = len(runs)
    if not k:
        return
    place = [0] * k
    key = lambda r: (0, runs[r][place[r]], r) if place[r] < len(runs[r]) else (1, None, r)
    less = lambda a, b: a[0] < b[0] or (a[0] == b[0] and (a[2] < b[2] if a[0] or a[1] == b[1] else a[1] < b[1]))
    keys, losers = [key(r) for r in range(k)], [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if less(keys[a], keys[b]) else (b, a)
    top = winners[1] if k > 1 else 0
    while keys[top][0] == 0:
        yield keys[top][1]
        place[top] += 1
        keys[top] = key(top)
        node = (top + k) // 2
        while node:
            if less(keys[losers[node]], keys[top]):
                top, losers[node] = losers[node], top
            node //= 2


def merge_index(runs: DataFrame) -> DataFrame:
    """All entries ordered by url_key, ts and page_id across partitions. Ranges split a key with many captures, too.

    A range gets its slice of every run from Spark's sort, which spills, in the order of archive and run_no: each slice
    arrives sorted, as the run was written, and the loser tree merges the slices without sorting again. What a task
    holds is one range, of about RANGE_ROWS narrow rows whatever the size of the table.
    """
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, F.col("url_key"), F.col("ts"), F.col("page_id").asc_nulls_first(), F.col("archive"), F.col("offset")).sortWithinPartitions("archive", "run_no")
    names = runs.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        archive = rows["archive"].to_pylist()
        starts = [k for k in range(len(archive)) if not k or archive[k] != archive[k - 1]]
        page = [(0, 0) if p is None else (1, p) for p in rows["page_id"].to_pylist()]
        entries = list(zip(rows["url_key"].to_pylist(), rows["ts"].to_pylist(), page, archive, rows["offset"].to_pylist(), range(len(page)), strict=True))
        slices = [entries[a:b] for a, b in zip(starts, [*starts[1:], len(entries)], strict=True)]
        order = pa.array([entry[-1] for entry in loser_tree(slices)], pa.int64())
        yield from rows.take(order).select(names).combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, runs.schema)


def capture_histories(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and returns their merged index."""
    spark = pages.sparkSession
    path = path or f"{tables_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return merge_index(written(index_runs(spark, path), "runs"))
