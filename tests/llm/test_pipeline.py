"""The pipeline against its parts by brute force on a small table."""

import numpy as np
import pytest

pytest.importorskip("pageloom.llm")
pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from pageloom.llm import near_copies, site_quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "PII", "mixing", "packing"]
    good = corpus_pipeline.quality(spark, docs, SF)
    weights = site_quality.train(docs, labels)
    verdict = {r.doc_id: r.kept for r in site_quality.site_quality(docs, weights).collect()}
    assert {r.doc_id for r in good.collect()} == {k for k, v in verdict.items() if v} and good.columns == docs.columns
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert sum(verdict[k] for k in bad) <= 0.1 * len(bad) and sum(not verdict[k] for k in clean) <= 0.02 * len(clean)
    one = corpus_pipeline.near_dedup(spark, good, SF)
    safe = corpus_pipeline.pii(spark, one, SF)
    assert safe.columns == docs.columns and safe.count() == one.count() and safe.where("text like '%@mail%'").count() == 0
    mixed = corpus_pipeline.mix(spark, safe, SF)
    assert mixed.columns == docs.columns
    got = corpus_pipeline.run(spark, SF).toPandas()
    tokens = got[got["start"] == 0]
    assert len(tokens) == mixed.count() and np.isclose(got["length"].sum(), tokens["doc_tokens"].sum())


def test_near_dedup_goes_by_fingerprints_too(spark):
    """Texts within two bits of SimHash are one, however unlike their five-word sets; so are texts of similar sets."""
    words = [f"w{k}" for k in range(120)]
    texts = ["red green blue " * 60 + "tail one", "red green blue " * 60 + "tail two", " ".join(words), " ".join([*words[:60], "edited", *words[61:]])]
    assert (near_copies.fingerprint(texts[0]) ^ near_copies.fingerprint(texts[1])).bit_count() <= 2
    assert (near_copies.fingerprint(texts[2]) ^ near_copies.fingerprint(texts[3])).bit_count() > 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {0, 2}


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, __key string, __copy int, copies int"


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing names; and an empty table."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(good)]
    rows += [rows[0], rows[1], rows[1], (rows[2][0], good[3], "de", "s1", 1), (None, good[4], None, None, None), (None, None, None, None, None), (900, "", "en", "s1", 0), (901, None, None, "s2", None), (902, " ".join(good) * 3, "en", None, 5), (903, good[5] + " mail a.b@c.de", "en", "s1", 3)]
    frame = spark.createDataFrame([(*r, "x", 7, "y", 1, 2) for r in rows], ODD)
    for name, docs in (("odd", frame), ("none", frame.where("false"))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, got = got, stage(spark, got, str(tmp_path / name))
            got.write.parquet(str(tmp_path / name / str(k)))
            got = spark.read.parquet(str(tmp_path / name / str(k)))
            if k < 4:
                assert got.columns == docs.columns
            if k == 1:
                kept = [tuple(r) for r in got.collect()]
                assert len(kept) == len(set(kept)) and {r[1] for r in kept} <= {r.text for r in before.collect()}
            if k == 2:
                assert got.where("text like '%a.b@c.de%'").isEmpty() and got.count() == len(kept)
        assert (got.count() > 0) == (name == "odd")
