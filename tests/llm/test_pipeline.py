"""The pipeline against its stages done in plain Python, and the driver's entry with and without the corpus package."""

import re

import corpus_pipeline
from inkstone.llm import decontaminate, quality_rules, secret_scan, simhash
from tests.conftest import DATA
from tests.llm.test_dedup import brute_groups
from tests.llm.test_native import plain_spans


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "secret scan", "sentencepiece encoding"]
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    figures = {r.doc_id: r for r in quality_rules.quality_figures(docs).collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if figures[r.doc_id].kept]
    kept = [(i, t) for i, t in kept if i in {c for _, _, c in brute_groups(kept)}]
    items = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)).lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)).lower()
    kept = [(i, t) for i, t in kept if not any(x[3:-3] in flat(t) for x in items)]
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in kept)
    assert all(r.round_trip for r in out)
    import hashlib

    digests = {r.doc_id: r.decoded_sha256 for r in out}
    for i, t in kept:
        spans, masked, at = plain_spans(t), "", 0
        for a, _, b, _ in spans:
            if a >= at:
                masked += t[at:a] + "[secret]"
            at = max(at, b)
        assert digests[i] == hashlib.sha256((masked + t[at:]).encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
        empty = stage(spark, docs.where("false"), sf)
        assert empty.dtypes == docs.dtypes and empty.count() == 0


def test_rejected_documents_go_and_clean_ones_stay(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    assert 0 < quality_rules.quality_filter(docs).count() < n
    assert 0 < simhash.keep_one(docs).count() < n
    assert 0 < decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() < n
    assert secret_scan.redact(docs).count() == n
