"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Defined results: null and empty texts are rows like others (a stage may drop them by its rule); equal rows become one at
the near-dedup stage; a null source or language is a site and a source of its own; an empty table of documents gives an
empty table; further columns of documents, of any name, pass all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import mixing, near_copies, packing, private_terms, site_quality
from pageloom.llm.queries import tokenizer
from pageloom.llm.shared import tables_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps; it is fitted on a bounded labelled sample."""
    return site_quality.keep_good(docs, site_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints of three words that the pigeonring links (2 bits, as
    in op7), and what those leave apart of texts whose five-word sets have a similarity of 0.8 or more."""
    return near_copies.one_of_each(docs, width=5, similarity=0.8, ring=near_copies.SHINGLE)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and without terms that disclose it."""
    return private_terms.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by their source's rate, in global random order."""
    return mixing.mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 1024 ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("PII", pii), ("mixing", mix), ("packing", pack)]
#: The classifier's fit, the components and the tokenizer are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{tables_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
