"""Token counts: dynamic programming over prefixes gives the exact count at every prefix of a text.

`token_counts` fills the table of each text at the ends of its pieces; its last entry is the count of the whole text,
and the longest prefix within a budget is found in it. `prefix_counts` returns the table at every character, from which
`within_budget` and `count_at` answer without encoding again. The longest prefix is the same everywhere: the most
characters k such that the first k have at most so many tokens (more characters can have fewer tokens).

Defined results: a null text counts as empty (0 tokens, 0 bytes); texts and words of any length are counted whole, in
time linear in them; repeated rows and equal texts get equal counts; an empty table gives an empty table; columns other
than id and text are not read, so extra columns of any name do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tokens import WordBpe

LIMIT = 2048
_MODELS: dict[str, WordBpe] = {}


def _model(path: str) -> WordBpe:
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix of at most `limit` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [model.count(t) for t in texts]
            fit = [model.longest_prefix(t, limit) if n > limit else len(t) for t, n in zip(texts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fit, pa.int64())], [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, prefix_tokens: the count of tokens of the first k characters, at index k (0 .. length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            for k, t in enumerate(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([model.every_prefix(t or "")], pa.list_(pa.int32()))], [id_col, "prefix_tokens"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, prefix_tokens array<int>")


def count_at(prefix_tokens: Column, chars: int) -> Column:
    """Tokens of the first `chars` characters (of the whole text if it is shorter)."""
    return F.get(prefix_tokens, F.least(F.lit(chars), F.size(prefix_tokens) - 1))


def within_budget(prefix_tokens: Column, budget: int) -> Column:
    """The most characters whose prefix has at most `budget` tokens (0 or more)."""
    return F.size(prefix_tokens) - F.array_position(F.reverse(F.transform(prefix_tokens, lambda c: c <= budget)), True)
