"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

`line_labels` decodes every line of a text with Viterbi; `quality_rules` adds the counts of the base rule and
keeps a document if it passes the base rule and enough of its words stand in content lines.

Documents are labelled, lines are not. A line of a good document starts as content, unless the corpus shows it to be
boilerplate: it stands between different lines in SPREAD places or more (copies of a document repeat a line's
neighbours, too, so they do not count). Lines of a bad document start as boilerplate; then each is judged by its own
features and the field is fitted again, so that those that read like content become content and labels change inside
documents. The fit maximises the pseudo-likelihood, which needs no recursion over lines.

Defined results: a null text counts as empty; an empty text has no words and fails the base rule; texts and lines of any
length are read whole, in training, too; ties go to content, and a share of exactly CONTENT_SHARE is kept; a document
without a label in training is still scored; an empty or missing training sample leaves the start weights, which
mark symbol-heavy, repeated and table lines as boilerplate. Repeated rows are scored alike. An empty table gives an empty
table. Only the id and text columns are read, so further columns of any name do not clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import labelled_sample, small, written

#: Labelled documents that the field is fitted on, at most.
TRAIN_DOCS = 2000
#: Different surroundings from which a line is boilerplate in training.
SPREAD = 5
#: A document is kept if at least this share of its words stands in content lines.
CONTENT_SHARE = 0.35
SYMBOLS = "#*$%&|<>"
_NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
_SPACES = " \t\n\v\f\r"
_DROP_SPACES = str.maketrans("", "", _SPACES)

FEATURES = ("bias", "words_1_2", "words_3_7", "words_20", "sentence_end", "bars", "symbols", "many_symbols", "upper", "shout", "digits", "run", "few_distinct", "repeated_line")
#: Weights for boilerplate before fitting, and how much two neighbours agree; used alone when there is no labelled document.
START, AGREE = np.zeros(len(FEATURES)), 0.5
START[0], START[[5, 7, 8, 9, 11, 12, 13]] = -1.0, 2.0
#: Rounds of fitting and decoding, and how strongly weights are held to those at the start.
ROUNDS, RIDGE = 3, 30.0


def line_features(words: list[str], line: str, repeated: bool) -> list[int]:
    """The active features of a line that has at least one word."""
    n = len(words)
    on = [0]
    if n <= 2:
        on.append(1)
    elif n <= 7:
        on.append(2)
    elif n >= 20:
        on.append(3)
    last = line.rstrip()[-1:]
    if last in ".!?:;\"'":
        on.append(4)
    bars = words.count("|")
    if bars * 5 > n:
        on.append(5)
    symbols = len(_NOT_SYMBOL.sub("", line))
    if symbols:
        on.append(6)
        if symbols * 4 > n:
            on.append(7)
    if line.isupper() and n > 2:
        on.append(8)
    if line.count("!") * 4 > n and n > 3:
        on.append(9)
    if sum(w[0].isdigit() for w in words) * 3 > n:
        on.append(10)
    if n > 5:
        if sum(map(str.__eq__, words, words[1:])) * 4 > n:
            on.append(11)
        if len(set(words)) * 2 < n:
            on.append(12)
    if repeated:
        on.append(13)
    return on


def lines_of(text: str) -> list[tuple[int, list[str], list[int]]]:
    """(number, words, features) of the lines with a word."""
    out, seen = [], set()
    for k, line in enumerate(text.split("\n")):
        words = [w for w in re.split(r"[ \t\n\v\f\r]+", line) if w]
        if words:
            out.append((k, words, line_features(words, line, line in seen)))
            seen.add(line)
    return out


def viterbi(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """The best label sequence for scores (lines x 2) and transition scores (2 x 2); ties go to content."""
    if not len(scores):
        return []
    rows, t00, t01, t10, t11 = scores.tolist(), *steps.ravel().tolist()
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        from_a, from_b = a + t00 < b + t10, a + t01 < b + t11
        back.append((from_a, from_b))
        a, b = (b + t10 if from_a else a + t00) + x, (b + t11 if from_b else a + t01) + y
    out = [int(b > a)]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return out[::-1]


def decoded(on: list[list[int]], model: tuple[np.ndarray, float]) -> list[int]:
    """The labels (0 content, 1 boilerplate) of lines with these active features."""
    weights, agree = model
    scores = np.zeros((len(on), 2))
    scores[:, 1] = [weights[f].sum() for f in on]
    return viterbi(scores, np.array([[agree, 0.0], [0.0, agree]]))


def pseudo_likelihood(seqs: list[list[list[int]]], labels: list[list[int]], important: list[float]) -> tuple[np.ndarray, float]:
    """Weights and agreement that make each line's label likeliest given its features and its neighbours' labels."""
    sizes = np.array([len(s) for s in seqs])
    every = [f for s in seqs for f in s]
    x = np.zeros((len(every), len(FEATURES) + 1))
    x[np.repeat(np.arange(len(every)), [len(f) for f in every]), np.concatenate(every)] = 1
    z = np.concatenate(labels).astype(float)
    ends = np.cumsum(sizes)
    inner = np.ones(len(z) - 1, bool)
    inner[ends[:-1] - 1] = False
    side = 2 * z - 1
    x[1:, -1] += np.where(inner, side[:-1], 0)
    x[:-1, -1] += np.where(inner, side[1:], 0)
    weight = np.repeat(important, sizes)
    prior = np.append(START, AGREE)
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (z - p)) - RIDGE * (w - prior))
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return w[:-1], max(float(w[-1]), 0.0)


def fit(sample: list[tuple[list[list[int]], list[int], int]], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, agreement) for documents given as (features of the lines, whether each is spread, quality)."""
    sample = [x for x in sample if x[0]]
    model = START.copy(), AGREE
    if len({y for _, _, y in sample}) < 2:
        return model
    seqs = [on for on, _, _ in sample]
    labels = [[1] * len(on) if not y else list(map(int, spread)) for on, spread, y in sample]
    good = sum(y for _, _, y in sample)
    # good and bad documents weigh alike, and so do a document's lines together and another's
    important = [100 / max(len(on), 1) * (0.5 / (good if y else len(sample) - good)) * 10 for on, _, y in sample]
    for _ in range(rounds):
        model = pseudo_likelihood(seqs, labels, important)
        for k, (on, spread, y) in enumerate(sample):
            if not y:
                new = [int(a or b) for a, b in zip(decoded(on, (model[0], 0.0)), spread, strict=True)]
                labels[k] = new if any(new) else [1] * len(on)
    return model


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pairs = a[:-1] * len(ids) + a[1:]
        if len(ids) > 1_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        _, inverse, counts = np.unique(pairs[:-1] * np.int64(len(ids)) + a[2:], return_inverse=True, return_counts=True)
        often = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= often
        repeat = int(covered.sum())
    return n, len(text.translate(_DROP_SPACES)), len(_NOT_SYMBOL.sub("", text)), dup, repeat


def judge(text: str | None, model: tuple[np.ndarray, float], share: float = CONTENT_SHARE) -> tuple:
    """The output row of one text, without its id."""
    text = text or ""
    n, chars, symbols, dup, repeat = base_counts(text)
    failed = n < 50 or 100 * repeat > 50 * n
    found = lines_of(text)
    labels = decoded([f for _, _, f in found], model)
    content = sum(len(w) for (_, w, _), k in zip(found, labels, strict=True) if not k)
    return n, chars, symbols, dup, repeat, failed, not failed and content >= share * n, len(found), sum(labels), content


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_boilerplate_lines long, n_content_words long"


def spread_lines(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, line_no of the sample's lines that stand in SPREAD or more different surroundings in all documents."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    # the outer form keeps Spark from splitting a second time in a filter on the number of lines
    own = sample.select("doc_id", F.posexplode_outer(lines).alias("line_no", "line")).where(F.col("line").rlike("[^ \\t-\\r]")).select("doc_id", "line_no", F.xxhash64("line").alias("h"))
    own = written(own, "lines")
    asked = small(written(own.select("h").distinct(), "asked"))
    at = lambda v, i: F.coalesce(F.get(v, i), F.lit(""))
    around = F.transform("lines", lambda line, i: F.struct(F.xxhash64(line).alias("h"), F.xxhash64(at(F.col("lines"), i - 1), at(F.col("lines"), i + 1)).alias("around")))
    every = docs.select(lines.alias("lines")).select(F.explode_outer(around).alias("x")).select("x.h", "x.around")
    many = every.join(asked, "h", "left_semi").distinct().groupBy("h").count().where(F.col("count") >= SPREAD)
    return own.join(small(written(many.select("h"), "spread")), "h", "left_semi").select("doc_id", "line_no")


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """The field fitted on at most `train_docs` labelled documents. Features are made where the texts are; the driver gets
    numbers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = lines_of(b.column(1)[k].as_py())
                masks = [sum(1 << j for j in f) for _, _, f in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(2).slice(k, 1), pa.array([[n for n, _, _ in found]], pa.list_(pa.int32())), pa.array([masks], pa.list_(pa.int32()))], ["doc_id", "y", "at", "masks"])

    sample = written(labelled_sample(docs, labels, "quality", train_docs), "sample")
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, at array<int>, masks array<int>").collect()
    spread: dict = {}
    for r in spread_lines(docs.select("doc_id", "text"), sample).collect():
        spread.setdefault(r.doc_id, set()).add(r.line_no)
    on = lambda mask: [j for j in range(len(FEATURES)) if mask >> j & 1]
    return fit([([on(m) for m in r.masks], [k in spread.get(r.doc_id, ()) for k in r["at"]], r.y) for r in sorted(rows, key=lambda r: r.doc_id)])


def quality_rules(docs: DataFrame, model: tuple[np.ndarray, float], share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, the verdicts and how many lines and words are content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t, model, share) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            kinds = [pa.bool_() if k in (5, 6) else pa.int64() for k in range(10)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_boilerplate_lines", "n_content_words"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, *names])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {SCHEMA}")


def line_labels(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: id, line_no, line, is_content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found, lines = lines_of(text or ""), (text or "").split("\n")
                labels = decoded([f for _, _, f in found], model)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), b.schema[0].type), pa.array([k for k, _, _ in found], pa.int64()), pa.array([lines[k] for k, _, _ in found], pa.string()), pa.array([not k for k in labels], pa.bool_())], [id_col, "line_no", "line", "is_content"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, line_no long, line string, is_content boolean")
