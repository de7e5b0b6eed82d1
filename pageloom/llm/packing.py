"""Packing: Karmarkar-Karp multiway differencing of document pieces into windows of near-equal size.

Documents are tokenised and cut into full windows and a tail of shorter pieces. Pieces meet in buckets, whose
number grows with the documents; in a bucket, blocks of pieces are divided over windows by differencing: partial
partitions with opposing imbalances are merged, largest spread first. If a window would exceed the capacity, the
window count of the block rises by one and the block is divided again.

Defined results: a null or empty text is the one closing id; rows with a null or repeated id, and equal rows, are packed
as rows of their own; texts of any length are packed whole; pieces of equal length go by the hash of their document; an
empty table gives no pieces; only the id and text columns are read, so extra columns of any name do not clash. Pieces
are dealt out by their document's content, so a task that is run again after a loss deals them out as before. Sequences have 1024 ids or, in
the last windows of a block, fewer and are then padded to 1024, or to the power of two that they fill exactly.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tokens import ByteBpe

CAPACITY = 1024
#: Tails are cut into pieces of at most this many ids, so that differencing can balance windows: documents up to it stay whole.
TAIL = 512
#: Documents to a bucket, and windows to a block of a bucket.
BUCKET_DOCS, BLOCK_WINDOWS = 2000, 128
_MODELS: dict[str, ByteBpe] = {}


def _model(path: str) -> ByteBpe:
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp for `windows` parts: lists of indices into sizes, with near-equal sums."""
    if windows == 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(windows - 1))]
    # A partial partition: sums from large to small less the smallest, and for each sum a chain of indices.
    heap: list = []
    for k, s in enumerate(sizes):
        heap.append((-s, k, [s], [(k, None)]))
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        # largest of one with the smallest of the other; only the sums above the smallest are kept in a and b
        if len(a) + len(b) <= windows:
            merged = [*zip(a, x, strict=True), *zip(b, y, strict=True)]
        else:
            pa_, pb = windows - len(a), windows - len(b)
            sa, ca = a + [0] * pa_, x + [None] * pa_
            sb, cb = ([0] * pb + b[::-1]), ([None] * pb + y[::-1])
            merged = [(p + q, c if d is None else d if c is None else (c, d)) for p, q, c, d in zip(sa, sb, ca, cb, strict=True)]
        merged.sort(key=lambda m: -m[0])
        floor = merged[-1][0] if len(merged) == windows else 0
        sums, chains = [m[0] - floor for m in merged], [m[1] for m in merged]
        ticket += 1
        heapq.heappush(heap, (-sums[0], ticket, sums, chains))
    out = []
    for chain in heap[0][3]:
        items, stack = [], [chain]
        while stack:
            c = stack.pop()
            if c is None:
                continue
            if c[1] is None:
                items.append(c[0])
            else:
                stack += c
        out.append(sorted(items))
    return out + [[] for _ in range(windows - len(out))]


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of indices) of at most `capacity`, near equal, as few as differencing can fill."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, count)
        if all(sum(sizes[k] for k in p) <= capacity for p in parts):
            return [p for p in parts if p]
        count += 1


def cuts(length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: full windows, then a tail in near-equal short pieces."""
    full = length // CAPACITY
    for k in range(full):
        yield k * CAPACITY, CAPACITY
    at, rest = full * CAPACITY, length % CAPACITY
    parts = -(-rest // TAIL)
    for k in range(parts):
        size = rest // parts + (k < rest % parts)
        yield at, size
        at += size


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "salt"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        model, task, again = _model(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            at, out = [], [[], [], [], [], []]
            for k, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                ids = model.ids(text.as_py() or "") + b"\0\0\0\0"
                view, n = memoryview(ids), len(ids) // 4
                row = xxh64_intdigest(view, xxh64_intdigest(repr(key)))
                again[row] += 1
                # equal rows are told apart by their number within the task, so a task that runs again, with its rows in
                # any order, deals out the same pieces
                salt = xxh64_intdigest(f"{row}:{task}:{again[row]}") >> 1
                for start, size in cuts(n):
                    at.append(k)
                    for c, v in zip(out, (start, size, zlib.crc32(view[start * 4 : (start + size) * 4]), n, salt), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names)

    pieces = source.mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")
    buckets = max(1, docs.count() // BUCKET_DOCS)

    def place(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["salt", "start"], ignore_index=True)
        sizes = got["length"].to_numpy()
        sequence, offset, window = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64), 0
        full = np.flatnonzero(sizes == CAPACITY)
        sequence[full] = np.arange(len(full))
        window, rest = len(full), np.flatnonzero(sizes < CAPACITY)
        ends = np.cumsum(sizes[rest]) // (BLOCK_WINDOWS * CAPACITY)
        for block in np.split(rest, np.flatnonzero(np.diff(ends)) + 1) if len(rest) else []:
            own = sizes[block].tolist()
            for part in windows_of(own):
                at = 0
                for k in part:
                    sequence[block[k]], offset[block[k]] = window, at
                    at += own[k]
                window += 1
        got["sequence_id"], got["offset"] = (int(key[0]) << 32) + sequence, offset
        return got[[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("salt", "start"), F.lit(buckets)))
    return spread.groupBy("bucket").applyInPandas(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
