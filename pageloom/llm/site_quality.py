"""Quality classifier: document evidence with host and path posteriors by hierarchical empirical Bayes.

A logistic model gives each document its evidence from features that Spark computes itself. Grouped sums of the
model's probabilities give every host a posterior mean that shrinks toward the global mean, and every path below a
host one that shrinks toward the host's; the prior strengths are estimated from the spread between hosts and between
paths (method of moments). A document's verdict adds the path's shift against the global mean to its own logit.

Host and path are two columns of the table, or come from a column of addresses by `site_of`. Documents have no address,
so the registered query takes their source as host and their language as path below it.

Defined results: a null text counts as empty, and a text of any length is read whole; null hosts or paths form a site of
their own; equal texts of a site get equal verdicts, and a probability of exactly KEEP is kept; without both labels in
the sample the model keeps its start weights; repeated rows count each; an empty table gives an empty table; extra
columns of any name do not clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import BROADCAST_ROWS, labelled_sample, met, written

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 2000
#: Weight of the site's shift, and the probability from which a document is kept.
SITE_WEIGHT, KEEP = 0.5, 0.35
#: Least and greatest prior strength, in documents.
STRENGTH = (5.0, 1000.0)

#: The characters that features count.
_SYMBOLS, _BARS, _SHOUTS, _DIGITS, _CAPITALS = "#*$%&<>", "|", "!?", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÑÓÇÊÍ"


def measured(rows: DataFrame) -> DataFrame:
    """rows (with a column t, the text) with n words, d different words, chars and marks, the counted characters.

    The text is split once and thinned to its marks once; each stands in a projection of its own, so that Spark does
    not compute it again for each feature.
    """
    others = [c for c in rows.columns if c != "t"]
    text = rows.select(*others, F.coalesce("t", F.lit("")).alias("t"))
    split = text.select(*others, F.filter(F.split("t", "[ \\t-\\r]+"), lambda w: w != "").alias("words"), F.length("t").alias("chars"), F.regexp_replace("t", f"[^{_SYMBOLS}{_BARS}{_SHOUTS}{_DIGITS}{_CAPITALS}]+", "").alias("marks"))
    return split.select(*others, F.greatest(F.size("words"), F.lit(1)).cast("double").alias("n"), F.size(F.array_distinct("words")).alias("d"), F.greatest("chars", F.lit(1)).cast("double").alias("chars"), "marks")


def features() -> list[Column]:
    """Numbers between about 0 and 1 that tell junk from prose, of the columns that `measured` gives."""
    n, d, chars, marks = F.col("n"), F.col("d"), F.col("chars"), F.col("marks")

    def share(of: str, scale: float = 1.0) -> Column:
        return F.least(F.lit(1.0), (F.length(marks) - F.length(F.translate(marks, of, ""))) / chars * scale)

    return [
        F.least(F.lit(1.0), F.log(n + 1) / 8),
        share(_SYMBOLS, 5.0),
        share(_BARS, 10.0),
        share(_SHOUTS, 5.0),
        share(_DIGITS, 3.0),
        share(_CAPITALS, 1.5),
        d / n,
        F.when(n > 20, F.log(d + F.lit(1.0)) / F.log(n + 1)).otherwise(1.0),
        F.least(F.lit(1.0), chars / n / 20),
    ]


#: Weights before fitting: bias, then one for each feature.
START = (0.5, 0.0, -6.0, -4.0, -4.0, -1.0, -4.0, 0.0, 2.0, 0.0)


def site_of(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port and www.) and path (the first part of several) of an address; null for none."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(F.lower(rest), r"^(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return host, F.regexp_extract(rest, r"^[^/?#]*/([^/?#]+)/", 1)


def fit(rows: list[tuple[list[float], int]]) -> list[float]:
    """Class-balanced logistic regression by Newton steps with a ridge toward START."""
    w0 = np.array(START)
    y = np.array([y for _, y in rows])
    if not rows or len(set(y.tolist())) < 2:
        return list(START)
    x = np.column_stack([np.ones(len(rows)), np.array([f for f, _ in rows])])
    weight = (0.5 / (np.bincount(y, minlength=2) / len(y)))[y]
    w = w0.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.3 * (w - w0)
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), grad)
    return [round(float(v), 6) for v in w]


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> list[float]:
    """The weights of the document model. Features are computed where the texts are; the driver gets numbers only."""
    sample = labelled_sample(docs, labels, "quality", train_docs)
    rows = measured(sample.select("y", "doc_id", F.col("text").alias("t"))).select("doc_id", F.array(*(f.cast("double") for f in features())).alias("f"), "y")
    return fit([(list(r.f), r.y) for r in sorted(rows.collect(), key=lambda r: r.doc_id)])


def evidence(weights: list[float]) -> Column:
    """The document's own logit, of the columns that `measured` gives."""
    out = F.lit(weights[0])
    for w, f in zip(weights[1:], features(), strict=True):
        out = out + F.lit(w) * f
    return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), out))


def posteriors(scored: DataFrame, host: str, path: str, p: str) -> DataFrame:
    """h, q (host and path), n (documents) and shift: the path's posterior logit less the global one. Sums are combined
    before the shuffle."""
    paths = written(scored.groupBy(F.col(host).alias("h"), F.col(path).alias("q")).agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy(F.col("h").alias("hh")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def spread(n: str, s: str, center: Column) -> Column:
        """The variance of the groups' means around their center, by size."""
        return F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - center, 2)) / F.sum(n)

    total = hosts.agg(F.sum("hn").alias("tn"), F.sum("hs").alias("ts"), F.count("*").alias("groups")).select("tn", "groups", (F.col("ts") / F.col("tn")).alias("m")).first()
    if total.m is None:
        return paths.select("h", "q", "n", F.lit(0.0).alias("shift"))
    m = min(max(total.m, 1e-4), 1 - 1e-4)

    def strength(between: float | None, groups: int, n: int) -> float:
        """Prior strength, in documents, from the variance between groups beyond what binomial noise explains."""
        noise = m * (1 - m) * groups / n
        return min(max(m * (1 - m) / max((between or 0.0) - noise, 1e-9) - 1, STRENGTH[0]), STRENGTH[1])

    k_host = strength(hosts.agg(spread("hn", "hs", F.lit(m)).alias("v")).first().v, total.groups, total.tn)
    both = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).select("h", "q", "n", "s", "hn", "hs")
    among = both.agg(spread("n", "s", F.col("hs") / F.col("hn")).alias("v"), F.count("*").alias("groups")).first()
    k_path = strength(among.v, among.groups, total.tn)
    host_mean = (F.col("hs") + F.lit(k_host * m)) / (F.col("hn") + F.lit(k_host))
    path_mean = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("s") + F.lit(k_path) * host_mean) / (F.col("n") + F.lit(k_path))))
    return both.select("h", "q", "n", (F.log(path_mean / (1 - path_mean)) - F.lit(float(np.log(m / (1 - m))))).alias("shift"))


def _own(docs: DataFrame, weights: list[float], keep_cols: list[str], site: tuple[Column, Column], text: str) -> DataFrame:
    """row (a struct of keep_cols), host, path and logit of each row."""
    # the row travels as one struct, so its columns cannot clash with those made here
    own = docs.select(F.struct(*keep_cols).alias("row"), site[0].alias("host"), site[1].alias("path"), F.col(text).alias("t"))
    return measured(own).select("row", "host", "path", evidence(weights).alias("logit"))


def _judged(own: DataFrame, scored: DataFrame) -> DataFrame:
    """own with shift and p; the sites' posteriors come from scored (host, path, logit)."""
    scored = scored.select("host", "path", (1 / (1 + F.exp(-F.col("logit")))).alias("p"))
    sites = written(posteriors(scored, "host", "path", "p").select(_site_key("h", "q"), F.col("n").alias("site_n"), F.col("shift").alias("site_shift")), "sites")
    keyed = own.withColumn("site", _site_key("host", "path"))
    joined = keyed.join(F.broadcast(sites), "site") if sites.count() <= BROADCAST_ROWS else met(keyed, sites, "site", "site_n")
    shifted = joined.withColumn("shift", F.coalesce("site_shift", F.lit(0.0)))
    return shifted.withColumn("p", 1 / (1 + F.exp(-(F.col("logit") + F.lit(SITE_WEIGHT) * F.col("shift")))))


def _site_key(host: str, path: str) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(F.length(part(host)).cast("string"), part(host), part(path)).alias("site")


def _site(host: str, path: str, url: str | None) -> tuple[Column, Column]:
    return site_of(F.col(url)) if url else (F.col(host), F.col(path))


def site_quality(docs: DataFrame, weights: list[float], host: str = "source", path: str = "lang", id_col: str = "doc_id", text: str = "text", url: str | None = None) -> DataFrame:
    """id, host, path, evidence, site_shift, quality (probability), kept. Texts are read once: logits are written, and
    only they meet the sites."""
    own = written(_own(docs, weights, [id_col], _site(host, path, url), text), "logits")
    out = _judged(own, own)
    return out.select(F.col("row")[id_col].alias(id_col), "host", "path", F.col("logit").alias("evidence"), F.col("shift").alias("site_shift"), F.col("p").alias("quality"), (F.col("p") >= KEEP).alias("kept"))


def keep_good(docs: DataFrame, weights: list[float], host: str = "source", path: str = "lang", text: str = "text", url: str | None = None) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    own = _own(docs, weights, docs.columns, _site(host, path, url), text)
    return _judged(own, own).where(F.col("p") >= KEEP).select(*(F.col("row")[c].alias(c) for c in docs.columns))
