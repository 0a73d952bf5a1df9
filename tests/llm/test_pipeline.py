"""The pipeline held against plain versions of its stages, and its parts among themselves."""

import re

import corpus_pipeline
from foliolake.llm import quality_rules, spm_sampling
from tests.llm.test_long_lines import plain_cut
from tests.llm.test_near_dedup import plain_groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[\w]+")


def shingles(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_pipeline(docs, kept, items):
    """{doc_id: text} after the four stages that keep the columns of documents."""
    docs = [(i, t) for i, t in docs if i in kept]
    docs = sorted(plain_cut(docs, words=50).items())
    groups = plain_groups(docs)
    docs = [(i, t) for i, t in docs if groups[i] == i]
    wanted = [shingles(t) for t in items]
    return {
        i: t for i, t in docs
        if not any(w and 100 * len(w & s) >= 80 * len(w) for s in [shingles(t)] for w in wanted)
    }


def test_run_equals_the_plain_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    kept = {r.doc_id for r in quality_rules.judged(documents).filter("kept").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_pipeline(docs, kept, items)
    got = corpus_pipeline.run(spark, SF)
    rows = spm_sampling.decoded(got).collect()
    assert {r.doc_id for r in rows} == set(want) and 0 < len(want) < len(docs)
    assert all(r.text == want[r.doc_id] and r.round_trip for r in rows)


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near dedup", "benchmark decontamination", "sentencepiece encoding",
    ]
    assert corpus_pipeline.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in corpus_pipeline.oracle_sql()


def test_encoding_does_not_depend_on_its_slices(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.LATTICE < spm_sampling.LATTICE
    plain = {(r.doc_id, r.draw): r for r in spm_sampling.sampled(documents).collect()}
    got = corpus_pipeline.encoding_stage(spark, documents, SF).collect()
    assert len(got) == len(plain) and all(plain[r.doc_id, r.draw] == r for r in got)
