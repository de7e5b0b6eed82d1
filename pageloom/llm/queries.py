"""The registered queries of the corpus operators, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import captures, licences, media, mixing, near_copies, packing, private_terms, quality_lines, site_quality, token_counts


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies; the file's place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_line_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return quality_lines.quality_rules(docs, quality_lines.fitted(docs, _t(spark, d, "labels")))


def op2_poisson_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents")).selectExpr("doc_id", "source", "text", "__copy as copy_no", "__copies as copies", "__order as order_key")


def op3_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licences.license_scan(_t(spark, d, "documents"))


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(_t(spark, d, "documents"), tokenizer("word_bpe_49k.json"))


def op5_private_terms(spark: SparkSession, d: str) -> DataFrame:
    return private_terms.private_spans(_t(spark, d, "documents"))


def op6_site_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return site_quality.site_quality(docs, site_quality.train(docs, _t(spark, d, "labels")))


def op7_near_copies(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_copies(_t(spark, d, "documents"))


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_capture_histories(spark: SparkSession, d: str) -> DataFrame:
    return captures.capture_histories(_t(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op10_media_columns(spark: SparkSession, d: str) -> DataFrame:
    return media.text_media(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_quality, op2_poisson_mix, op3_license_scan, op4_token_counts, op5_private_terms, op6_site_quality, op7_near_copies, op8_packing, op9_capture_histories, op10_media_columns)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_poisson_mix": """
with sizes as (select source as s, count(*) as n, pow(count(*)::double, 0.7) as w from documents group by 1),
total as (select sum(n) as tn, sum(w) as tw from sizes),
rated as (select s, least(16.0, round((tn / tw) * w / n, 9)) as rate from sizes, total),
drawn as (select doc_id, source, text, rate, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint::double / 4503599627370496.0 as u,
  coalesce(doc_id::varchar, md5(coalesce(text, ''))) as key
  from documents join rated on source is not distinct from s),
steps as (select s, rate, k, exp(-rate) * pow(rate, k) / gamma(k + 1.0) as p from rated, range(0, 65) t(k)),
cum as (select s, k, sum(p) over (partition by s order by k) as c from steps),
counted as (select doc_id, source, text, key, (select count(*) from cum where s is not distinct from source and c <= u and k < 64) as copies from drawn)
select doc_id, source, text, copy_no::int as copy_no, copies::int as copies, md5('mix-1/order:' || key || ':' || copy_no) as order_key
from counted, lateral (select unnest(range(1, copies + 1)) as copy_no) where copies > 0""",
    }
