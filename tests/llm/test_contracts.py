"""The queries without full SQL, held against plain versions over their whole tables."""

import numpy as np
import pytest

from foliolake.llm import queries
from tests.llm.helpers import (
    plain_components,
    plain_fingerprint,
    plain_licenses,
    plain_line_dedup,
    plain_substring_dedup,
    plain_unigram,
    remainder,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_license_scan(spark, documents):
    got = rows(queries.op2_license_scan(spark, SF))
    assert len(got) == len(documents)
    for i, text in documents:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_lm_scoring(spark, documents):
    got = rows(queries.op3_lm_scoring(spark, SF))
    want = plain_unigram(documents)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, remainder(i, 7) == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the model beats add-one unigrams


def test_simhash(spark, documents):
    got = rows(queries.op5_simhash_dedup(spark, SF))
    want = plain_components(documents)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == want


def test_substring_dedup(spark, documents):
    got = rows(queries.op6_substring_dedup(spark, SF))
    want = plain_substring_dedup(documents)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want


def test_line_dedup(spark, documents):
    from foliolake.llm.line_dedup import report

    got = rows(report(spark.read.parquet(f"{SF}/documents.parquet")))
    want = plain_line_dedup(documents)
    assert {i: (r.n_lines, r.n_removed, r.kept_text) for i, r in got.items()} == want


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(queries.op8_quality_classifier(spark, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels.items() if remainder(i, 5) == 0]
    assert np.mean([p == y for p, y in held]) > 0.9
    low = np.mean([got[i].score for i, y in labels.items() if y == 0])
    assert low < np.mean([got[i].score for i, y in labels.items() if y == 1]) - 0.4


def test_sampled_segmentations(spark, documents):
    got = queries.op1_sentencepiece_sampling(spark, SF).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {i for i, _ in documents}
    for own in by_doc.values():
        assert all(r.round_trip and 0 <= r.inclusion <= 1 and r.n_pieces == len(r.ids) for r in own)
        assert len({tuple(r.ids) for r in own}) == len(own)


def test_fingerprint_definition():
    assert plain_fingerprint("") == 0
    from foliolake.llm.simhash_dedup import fingerprint

    for text in (None, "", "A", "A b", "A b C", "ümlaut A\x0bb c d", "x " * 70000):
        assert fingerprint(text) == plain_fingerprint(text)


def test_a_text_with_the_mark_does_not_come_back(spark):
    from foliolake.llm import spm_sampling

    table = spark.createDataFrame([(1, "a▁b c"), (2, "a b c"), (3, None), (4, "x" * 3000 + " " + "y" * 100)], "doc_id bigint, text string")
    found = {(r.doc_id, r.round_trip) for r in spm_sampling.sampled(table).collect()}
    assert found == {(1, False), (2, True), (3, True), (4, True)}


def test_slices_do_not_change_the_rows(spark):
    from foliolake.llm import spm_sampling

    table = spark.createDataFrame([(k, f"some words {k} and " + "z" * (k % 70) * k) for k in range(40)], "doc_id bigint, text string").coalesce(1)
    whole = sorted(map(tuple, spm_sampling.sampled(table).drop("log_prob", "inclusion").collect()))
    assert whole == sorted(map(tuple, spm_sampling.sampled(table, slice_bytes=200).drop("log_prob", "inclusion").collect()))


def test_counts_that_do_not_fit_are_refused():
    from foliolake.llm import exchange, lm_scoring

    values = np.array([0, 5, (1 << 40) + 5, (1 << 48) - 1], np.uint64)
    assert (exchange.from_planes(exchange.to_planes(values, lm_scoring.COUNT_BYTES), lm_scoring.COUNT_BYTES) == values).all()
    with pytest.raises(OverflowError):
        exchange.to_planes(values + np.uint64(1), lm_scoring.COUNT_BYTES)
