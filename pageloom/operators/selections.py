"""The crawl record's selector projection, and sinks for crawl records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.article import collapse
from pageloom.plans.match import selection_texts
from pageloom.sources.html import ParseError, parse

JOINT, SECTION = "\n\n", "\n\n---\n\n"


def selections(pages: DataFrame, selectors: list[str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, selections (selector, plain_text, match_count; in the order given), plain_text of all sections.

    An invalid selector matches nothing; a page that cannot be built has no match.
    """
    source = pages.select(id_col, html_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, html in b.itertuples(index=False, name=None):
                try:
                    page = parse(html or "")
                    found = [selection_texts(page, s, collapse) for s in selectors]
                except ParseError:
                    found = [[] for _ in selectors]
                parts = [{"selector": s, "plain_text": JOINT.join(t for t in texts if t), "match_count": len(texts)} for s, texts in zip(selectors, found, strict=True)]
                rows.append((key, parts, SECTION.join(p["plain_text"] for p in parts if p["plain_text"])))
            yield pd.DataFrame(rows, columns=[id_col, "selections", "plain_text"])

    return source.mapInPandas(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, selections array<struct<selector:string,plain_text:string,match_count:int>>, plain_text string")


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def write_jsonl(records: DataFrame, path: str, mode: str = "append") -> None:
    """One camelCase object to a line, without nulls."""
    records.select(*(F.col(c).alias(camel(c)) for c in records.columns)).write.mode(mode).option("ignoreNullFields", "true").json(path)


def stream_jsonl(records: DataFrame, path: str, checkpoint: str):
    """The same from a stream, each micro-batch once."""
    return records.writeStream.foreachBatch(lambda batch, _: write_jsonl(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
