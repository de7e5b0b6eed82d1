"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits in a ring of five segments. If two differ in at most 2 bits, then by the pigeonring
principle some segment starts a chain whose sums of differences stay within l * 2/5 for every length l: sums of at
most 0, 0, 1, 1, 2. The first two budgets make two consecutive segments equal, which is the join key; the others
prune candidates before the full Hamming check. Keys that more than BUCKET fingerprints share take an exact other
way: there, fingerprints link if they have a common neighbour at distance 1 or less, so each is listed under its
own value and its one-bit neighbours in the free segments and all under one value are joined to the smallest; that
is linear in the bucket. Links between different fingerprints go to alternating large-star and small-star steps.

`similar_copies` is the rule by similarity: texts whose sets of shingles have a Jaccard similarity of at least a given
share. Such pairs differ in about 10 of the 64 bits at 0.8, more than any ring can be laid out for, so candidates come
from BANDS keys of ROWS minima of the shingles' hashes (a pair at 0.8 is missed with probability 3e-6), and every
candidate is checked on its exact sets: all texts of a key against one centre, then those that this leaves apart, each
pair under the first key it shares, where a sketch of the minima does not already tell them apart (it errs on a pair at
the similarity with probability 2e-8). With `ring`, texts whose fingerprints of that width link are joined before, by the
pigeonring, so that only what the fingerprints leave apart is to be compared.

Defined results: a null text counts as empty; texts without a word have fingerprint zero, linked like any other;
rows with a null id get a component like others but never name it unless all ids are null (then null); repeated
rows share a component; an empty table gives an empty table; texts are read whole, whatever their length; only the id
and text columns are read, so extra columns of any name do not clash. Texts are told apart by 64-bit hashes of their
words, as the fingerprints themselves are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import met, small, written

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: First bit and width of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints under one key that are compared in pairs, at most; larger keys go by common neighbours.
BUCKET = 48
#: Keys of a text for candidates by similarity, and minima in each; pairs of one text that go to one task.
BANDS, ROWS, PAIRS = 32, 5, 1000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint: bits that over half the shingles' XXH64 values have."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
    ones, total = np.zeros(64, np.int64), n - width + 1
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, total)
    for k in range(0, total, 65536):
        ones += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(">u8")[0])


def _passed(source: DataFrame, text_col: str) -> tuple[list[str], str]:
    """The columns beside the text, and their types."""
    fields = [f for f in source.schema if f.name != text_col]
    return [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (the id, the text and what else is to pass) with fp, the fingerprint as a signed long, in place of the text."""
    names, types = _passed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fps)], [*names, "fp"])

    return docs.mapInArrow(run, f"{types}, fp long")


def _bits(segment: int) -> int:
    first, width = SEGMENTS[segment % 5]
    mask = ((1 << width) - 1) << first
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _in_segments(x: Column, segments: range) -> Column:
    mask = 0
    for s in segments:
        mask |= _bits(s) & ((1 << 64) - 1)
    return F.bit_count(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))


def ring_chain(x: Column, start: int, distance: int = DISTANCE) -> Column:
    """Whether the chain from `start` keeps its budgets at every length; x: the differing bits of a pair."""
    ok = F.lit(True)
    for length in range(1, 6):
        ok = ok & (_in_segments(x, range(start, start + length)) <= length * distance // 5)
    return ok


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a < b) of distinct fingerprints `fp`: all pairs within the distance, or for crowded keys a star of links
    that joins the same fingerprints."""
    if distance != 2:
        raise ValueError("the ring is laid out for a distance of 2")
    both = [F.lit(_bits(s) | _bits(s + 1)) for s in range(5)]
    keys = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(m) for m in both))).alias("seg", "part"))
    crowded = small(written(keys.groupBy("seg", "part").count().where(F.col("count") > BUCKET).select("seg", "part"), "crowded"))
    few, many = keys.join(crowded, ["seg", "part"], "left_anti"), keys.join(crowded, ["seg", "part"], "left_semi")
    x = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.expr("false")
    for s in range(5):
        chain = F.when(F.col("l.seg") == s, ring_chain(F.col("l.fp").bitwiseXOR(F.col("r.fp")), s)).otherwise(chain)
    pairs = few.alias("l").join(few.alias("r"), (F.col("l.seg") == F.col("r.seg")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.fp") < F.col("r.fp")) & chain)
    pairs = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).where(F.bit_count(x) <= distance)
    free = [[b for b in range(64) if not (_bits(s) | _bits(s + 1)) >> b & 1] for s in range(5)]
    flips = F.lit(None).cast("array<bigint>")
    for s in range(5):
        flips = F.when(F.col("seg") == s, F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in free[s]))).otherwise(flips)
    near = many.select("seg", "part", "fp", F.explode(flips).alias("flip")).select("seg", "part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("seg", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("seg", "value", "a")
    stars = near.join(least, ["seg", "value"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root of the nodes of `edges` (a < b): the smallest node reachable, by alternating stars."""
    edges = written(edges, "links")
    seen = None
    for _ in range(most):
        # large star: neighbours above a node go to the smallest node around it
        around = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = around.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: a node and its neighbours below go to the smallest of them
        least = big.groupBy("b").agg(F.min("a").alias("m"))
        joined = big.join(least, "b")
        edges = written(joined.select(F.col("m").alias("a"), "b").union(joined.where("a > m").select(F.col("m"), F.col("a"))).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {most} rounds")


def _groups(own: DataFrame, key: str, id_col: str, tied: DataFrame) -> DataFrame:
    """One row per key: n rows, component_id, root (a key of the component), alone (whether no other key is in it)."""
    groups = written(own.groupBy(key).agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "groups")
    # only linked keys differ from their own group's least id
    linked = groups.join(tied.select(F.col("node").alias(key), "root"), key).select(key, "n", "least", "root")
    roots = groups.join(tied.select(F.col("root").alias(key)).distinct(), key, "left_semi").select(key, "n", "least", F.col(key).alias("root"))
    linked = written(linked.unionByName(roots), "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("linked_id"))
    moved = written(linked.join(named, "root").select(F.col(key), "root", "linked_id"), "moved")
    final = groups.join(small(moved), key, "left")
    return written(final.select(key, "n", F.coalesce("linked_id", "least").alias("component_id"), F.coalesce("root", key).alias("root"), F.col("root").isNull().alias("alone")), "final")


def _near(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    own = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    return own, _groups(own, "fp", id_col, components(links(written(own.select("fp").distinct(), "distinct"))))


def near_copies(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable)."""
    own, final = _near(docs.select(id_col, text_col), width, id_col, text_col)
    rows = met(own, final.select("fp", "n", "component_id"), "fp", "n")
    return rows.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Words whose hashes a worker remembers, at most.
WORDS = 100_000
_words: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a result depends on every bit of its number."""
    for factor in _MIX[1:3]:
        h = (h ^ (h >> _MIX[3])) * factor
    return h ^ (h >> _MIX[3])


def shingles(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """A key of the words (a signed long) and the hashes of all shingles in order; none without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    key, n = xxh64_intdigest(b" ".join(words), SEED + 1), len(words)
    if len(_words) > WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxh64_intdigest(w, SEED)
    of = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    count = max(n - width + 1, min(n, 1))
    h = np.zeros(count, np.uint64)
    for k in range(min(width, n)):
        h = (h + of[k : k + count]) * _MIX[0]
    return key - (1 << 64) * (key >> 63), _mixed(h)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys and a sketch (signed longs) for each of several lists of shingles, none of them empty. The sketch has
    four bits of each of the minima, 16 to a long."""
    if not sets:
        return np.empty((0, BANDS), np.int64), np.empty((0, BANDS * ROWS // 16), np.int64)
    every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    least = np.stack([np.minimum.reduceat(every * a, starts) for a in _ODD], 1).reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS))
    for k in range(ROWS):
        keys = _mixed((keys + least[:, :, k]) * _MIX[0])
    nibbles = (_mixed(least.reshape(len(sets), -1, 16)) & np.uint64(15)) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return keys.view(np.int64), np.bitwise_or.reduce(nibbles, axis=2).view(np.int64)


def unlike(a: str, b: str) -> Column:
    """How many nibbles of two sketches differ."""
    total = F.lit(0)
    for k in range(BANDS * ROWS // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(0x3333333333333333))
        total = total + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    return total


def most_unlike(similarity: float) -> int:
    """The nibbles that may differ: 5.5 deviations more than are to be expected at the similarity."""
    n, p = BANDS * ROWS, (1 - similarity) * 15 / 16
    return int(n * p + 5.5 * (n * p * (1 - p)) ** 0.5)


def _parts(b: pa.RecordBatch, text_col: str, width: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The rows of a batch with their shingles, in parts of a bounded number of shingles (or of one text)."""
    at, got, size = 0, [], 0
    for k, t in enumerate(b.column(text_col)):
        got.append(shingles(t.as_py(), width))
        size += len(got[-1][1])
        if size > 200_000 or k == b.num_rows - 1:
            yield b.slice(at, len(got)), got
            at, got, size = k + 1, [], 0


def _signed(docs: DataFrame, width: int, text_col: str, ring: int | None = None) -> DataFrame:
    """The columns beside the text, key and h, the band keys, and s, the sketch (both empty without a word); with `ring`
    also fp, the fingerprint of that width."""
    names, types = _passed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, got in _parts(b, text_col, width):
                there = np.cumsum([0, *(len(h) > 0 for _, h in got)])
                lists = [pa.ListArray.from_arrays(pa.array(there * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in signatures([h for _, h in got if len(h)])]
                own = [*(part.column(n) for n in names), pa.array([k for k, _ in got], pa.int64()), *lists]
                if ring:
                    own.append(pa.array(np.array([fingerprint(t.as_py(), ring) for t in part.column(text_col)], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays(own, [*names, "key", "h", "s", *["fp"] * bool(ring)])

    return docs.mapInArrow(run, f"{types}, key long, h array<long>, s array<long>" + ", fp long" * bool(ring))


def _sets(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """key and h, the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, got in _parts(b, text_col, width):
                sets = [np.unique(h).view(np.int64) for _, h in got]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), lists], ["key", "h"])

    return docs.select(text_col).mapInArrow(run, "key long, h array<long>")


def _jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and j, the similarity of their sets (key, h). An a of many pairs is dealt out to several tasks."""
    share = F.ceil(F.col("count") / PAIRS).cast("int")
    own = pairs.groupBy("a").count().join(sets.toDF("a", "ha"), "a").select("a", "ha", share.alias("of"), F.explode(F.sequence(F.lit(0), share - 1)).alias("salt"))
    dealt = pairs.join(pairs.groupBy("a").count().select("a", share.alias("of")), "a").select("a", "b", F.pmod(F.xxhash64("b"), "of").cast("int").alias("salt"))
    both = dealt.join(sets.toDF("b", "hb"), "b").join(own.drop("of"), ["a", "salt"])
    common = F.size(F.array_intersect("ha", "hb"))
    return both.select("a", "b", (common / (F.size("ha") + F.size("hb") - common)).alias("j"))


def ring_links(signed: DataFrame) -> DataFrame:
    """a, b: for the keys of each component of fingerprints (key, fp), a star of links around the smallest."""
    each = written(signed.select("key", "fp").distinct(), "each")
    fps = written(each.groupBy("fp").agg(F.count("*").alias("n")), "distinct")
    tied = written(components(links(fps.select("fp"))).withColumnRenamed("node", "fp"), "tied")
    fps = written(fps.join(small(tied), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    each = written(met(each, fps, "fp", "n").select("key", "root"), "each")
    least = written(each.groupBy("root").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1"), "least")
    return written(met(each, least, "root", "n").where("a < key").select("a", F.col("key").alias("b")), "ring")


def similar_links(docs: DataFrame, signed: DataFrame, width: int, similarity: float, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """a, b: links of distinct keys of texts whose sets of shingles have at least the similarity, such that the same texts
    are joined as by all candidates' links; with them those `known` before.

    Under each band key all texts are first compared with one centre, the same for as many keys as can be; the rows made
    grow with the table, whatever the sizes of groups. Where that leaves several components under a key, the texts
    outside the largest one are compared with those of other components, unless their similarities to the centre
    differ by too much (1 less the similarity is a metric) or their sketches do, or they share a smaller key, under which
    they meet as well. The join sees to all this itself, so it makes only links that the centres have missed, each once;
    what it looks at under such a key still grows with the square of the texts that are near one another but not near
    enough.
    """
    distinct = written(signed.groupBy("key").agg(F.first("h").alias("h"), F.first("s").alias("s")), "distinct")
    keys = written(distinct.select("key", F.explode("h").alias("part")), "keys")
    heads = written(keys.groupBy("part").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64("key")).alias("a")).where("n > 1"), "heads")
    members = written(met(keys, heads, "part", "n").select("part", "key", "a", "n"), "members")
    used = small(written(members.select("key").distinct(), "used"), 500_000)
    sets = _sets(docs, width, text_col).join(used, "key", "left_semi").groupBy("key").agg(F.first("h").alias("h"))
    sets = written(sets, "sets")
    star = written(members.where("key <> a").select("a", F.col("key").alias("b")).distinct(), "star")
    told = written(_jaccard(star, sets), "told")
    links = told.where(F.col("j") >= similarity).select("a", "b")
    links = links if known is None else links.unionByName(known)
    tied = written(components(_ordered(links)).withColumnRenamed("node", "key"), "tied")
    rooted = written(members.join(tied, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    apart = written(rooted.groupBy("part").agg(F.first("n").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("part", "m"), "apart")
    if apart.isEmpty():
        return links
    near = met(rooted, apart, "part", "m").join(told.select("a", F.col("b").alias("key"), "j"), ["a", "key"], "left")
    near = written(near.select("part", "key", "root", "m", F.coalesce("j", F.lit(1.0)).alias("j")), "near")
    top = near.groupBy("part", "root").agg(F.count("*").alias("c"), F.first("m").alias("m")).groupBy("part").agg(F.first("m").alias("m"), F.max_by("root", F.struct("c", "root")).alias("top"))
    step = 1 - similarity
    near = met(near.drop("m"), written(top, "top"), "part", "m").withColumn("slot", F.floor(F.col("j") / step))
    near = written(near.join(distinct.select("key", "s", F.col("h").alias("keys")), "key").join(sets, "key"), "slots")
    rest = near.where("root <> top").select("part", F.col("key").alias("a"), F.col("root").alias("ra"), F.col("j").alias("ja"), F.col("s").alias("sa"), F.col("keys").alias("keysa"), F.col("h").alias("ha"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    other = (F.col("ra") != F.col("root")) & (F.abs(F.col("ja") - F.col("j")) <= step + 1e-9) & ((F.col("root") == F.col("top")) | (F.col("a") < F.col("key"))) & (unlike("s", "sa") <= most_unlike(similarity))
    first = F.array_min(F.array_intersect("keys", "keysa")) == F.col("part")
    # the exact sets are the join's last condition, so that it makes links only, not one row for each pair it looks at
    common = F.size(F.array_intersect("h", "ha"))
    exact = common / (F.size("h") + F.size("ha") - common) >= similarity
    more = near.join(rest, ["part", "slot"]).where(other & first & exact).select("a", F.col("key").alias("b"))
    return links.unionByName(more)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alike(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str, ring: int | None = None) -> tuple[DataFrame, DataFrame]:
    signed = written(_signed(docs, width, text_col, ring), "signatures")
    known = ring_links(signed) if ring else None
    tied = components(_ordered(similar_links(docs, signed, width, similarity, text_col, known)))
    return signed.drop("h", "s", *["fp"] * bool(ring)), _groups(signed, "key", id_col, tied)


def similar_copies(docs: DataFrame, width: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", ring: int | None = None) -> DataFrame:
    """One row per document: id, component_id (the smallest id reachable over pairs of at least the similarity, and with
    `ring` over pairs whose fingerprints of that width differ in at most DISTANCE bits)."""
    own, final = _alike(docs.select(id_col, text_col), width, similarity, id_col, text_col, ring)
    return met(own, final.select("key", "n", "component_id"), "key", "n").select(id_col, "component_id")


def _hashes(docs: DataFrame) -> list[Column]:
    """Two hashes of the whole row, __a and __b."""
    own = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return [F.xxhash64(*own).alias("__a"), F.xxhash64(F.lit(1), *own).alias("__b")]


def one_of_each(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, ring: int | None = None) -> DataFrame:
    """One row of docs for each component: that with the smallest id (any id before none; ties by a hash of the row). With a
    similarity the components are those of `similar_copies` (with `ring` if given), else those of `near_copies`.

    Rows are told apart as a whole: of rows that share an id each stands for its own text, and of rows that are equal in
    every column one stays. An empty table gives an empty table.
    """
    rows = docs.select(id_col, text_col, *_hashes(docs))
    own, final = _near(rows, width, id_col, text_col) if similarity is None else _alike(rows, width, similarity, id_col, text_col, ring)
    key = "fp" if similarity is None else "key"
    several = met(own, final.where("n > 1 or not alone").select(key, "n", "root"), key, "n").select("root", id_col, "__a", "__b")
    several = written(several, "several")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__a").alias("a"), F.col("__b").alias("b"))
    best = written(several.groupBy("root").agg(F.min(first).alias("best"), F.count("*").alias("n")), "best")
    judged = met(several, best, "root", "n").select("__a", "__b", ((F.col("__a") == F.col("best.a")) & (F.col("__b") == F.col("best.b"))).alias("stays"))
    judged = written(judged.groupBy("__a", "__b", "stays").count(), "judged")
    drop = judged.where("not stays").select("__a", "__b").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("row"), *_hashes(docs))
    left = whole.join(small(drop, 500_000), ["__a", "__b"], "left_anti")
    again = written(judged.where("stays and count > 1").select("__a", "__b"), "again")
    if not again.isEmpty():
        once = whole.join(small(again, 500_000), ["__a", "__b"], "left_semi").groupBy("__a", "__b").agg(F.first("row").alias("row"))
        left = left.join(small(again, 500_000), ["__a", "__b"], "left_anti").unionByName(once.select(*left.columns))
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))
