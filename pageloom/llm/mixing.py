"""Mixing sources to target weights by Poisson replication.

A source whose target share is w and whose natural share is n gets the mean repetition rate w / n (times the wanted
growth). Each document draws its count by inverting the Poisson distribution at a uniform number made from a hash of
seed and id, is exploded by that count, and all copies are ordered globally by another hash. A rate over ONE_DRAW is
drawn as the sum of independent draws of equal rates, which has the same distribution.

Defined results: the draw depends on id and text only, so repeated rows draw alike; null ids draw by their text; a
null source is a source of its own. Without weights a source's target is its size to the power TEMPERATURE. With weights the
named sources share among them, by their weights, as many rows as they have (times the growth); a source that is not
named keeps its size (times the growth), and one of weight 0 goes. An empty table gives an empty table; texts are not
looked into, so their length does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import small, written

SEED = "mix-1"
#: Target weights are natural sizes to this power, unless weights are given.
TEMPERATURE = 0.7
#: Terms of the inversion's cumulative sums; at ONE_DRAW, the highest rate of one draw, the mass beyond is under 1e-12.
TERMS, ONE_DRAW = 64, 16.0


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of an MD5; the same in any engine."""
    return _uniform(F.concat(F.lit(seed + ":"), key))


def _uniform(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k whose cumulative probability exceeds u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
    step = lambda a, i: F.struct((a["p"] * rate / i).alias("p"), (a["c"] + a["p"] * rate / i).alias("c"), F.when(a["c"] <= u, i).otherwise(a["k"]).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["k"]


def copies_drawn(key: Column, seed: str, rate: Column) -> Column:
    """The count of a document at any rate; the first draw's number is uniform(key, seed)."""
    draws = F.ceil(rate / ONE_DRAW).cast("int")
    number = lambda i: F.concat(F.lit("/draw-"), i.cast("string"), F.lit(":"), key)
    u = lambda i: F.when(i == 1, uniform(key, seed)).otherwise(_uniform(F.concat(F.lit(seed), number(i))))
    several = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda n, i: n + poisson_count(u(i), rate / draws))
    return F.when(rate > ONE_DRAW, several).otherwise(poisson_count(uniform(key, seed), rate))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, growth: float = 1.0, source: str = "source") -> DataFrame:
    """__s, __rate: the mean repetitions of each source. Counts are combined before the shuffle."""
    sizes = docs.select(F.col(source).alias("__s")).groupBy("__s").agg(F.count("*").alias("__n"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.pow(F.col("__n"), F.lit(TEMPERATURE)))
    else:
        given = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))) if weights else F.create_map().cast("map<string,double>")
        sizes = sizes.withColumn("__w", F.when(F.col("__s").isNotNull(), F.try_element_at(given, F.col("__s").cast("string"))))
    named = F.col("__w").isNotNull()
    t = sizes.agg(F.sum(F.when(named, F.col("__n"))).alias("tn"), F.sum("__w").alias("tw")).first()
    share = F.round(F.lit(growth * t.tn / t.tw) * F.col("__w") / F.col("__n"), 9) if t.tn and t.tw else F.lit(0.0)
    return sizes.select("__s", F.when(named, share).otherwise(growth).alias("__rate"))


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column is called so (Spark's names do not tell case)."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def mix(docs: DataFrame, weights: dict[str, float] | None = None, growth: float = 1.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source: str = "source", shuffle: bool = True) -> DataFrame:
    """The columns of docs and __copy (1 ..), __copies, __order; rows are in global random order if shuffle is true.

    A column of docs that is called so keeps its name; the new one then has more underscores. The order's first digits
    are evenly spread, so the ranges of its partitions are known without a sample, and texts are read once.
    """
    rated = small(written(rates(docs, weights, growth, source), "rates"))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    # the row travels as one struct, so its columns cannot clash with those made here
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.col(source).alias("src"))
    joined = rows.join(rated, F.col("src").eqNullSafe(F.col("__s")), "left")
    counted = joined.withColumn("rate", F.coalesce("__rate", F.lit(0.0))).withColumn("copies", copies_drawn(F.col("key"), seed, F.col("rate")))
    out = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.md5(F.concat(F.lit(seed + "/order:"), F.col("key"), F.lit(":"), F.col("copy").cast("string")))
    out = out.select("row", "copy", "copies", order.alias("order"))
    if shuffle:
        ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")
        out = out.repartitionById(ranges, place).sortWithinPartitions("order", "copy")
    new = [F.col(c).alias(free_name(f"__{c}", docs.columns)) for c in ("copy", "copies", "order")]
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns), *new)
