"""Small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from foliolake.llm import (
    decontamination,
    exchange,
    license_scan,
    line_dedup,
    lm_scoring,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    spm_sampling,
    substring_dedup,
    warc,
    words,
)
from tests.llm.helpers import plain_components, plain_licenses, plain_line_dedup, plain_substring_dedup, remainder

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions near old stone walls".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 200_000), (6, "a b " * 20_000), (None, "the end of it"),
    (None, None), (7, " ".join(WORDS)), (7, " ".join(WORDS)), (8, "\n".join(WORDS)), (9, "\n".join(WORDS)),
    (10, "ünï cödé ♞ 漢字 \U0001f600 " * 30),
]


def table(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def clash(docs):
    """The table with extra columns that have the names operators use inside or return."""
    from pyspark.sql import functions as F

    names = ("chunk", "bucket", "keys", "fp", "root", "shingle", "hash", "kept", "n_words", "_words", "ids", "score", "_starts", "_key")
    return docs.withColumns({n: F.lit(n) for n in names})


OPERATORS = {
    "sampling": spm_sampling.sampled,
    "licenses": license_scan.scanned,
    "scores": lm_scoring.scored,
    "near": simhash_dedup.components,
    "substrings": substring_dedup.removed_repeats,
    "rules": quality_rules.judged,
    "lines": line_dedup.report,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, none, name):
    run = OPERATORS[name]
    rows = run(odd).collect()
    assert run(none).collect() == []
    count = len({(r.doc_id, r.draw, tuple(r.ids)) for r in rows if r.draw == 0}) if name == "sampling" else len(rows)
    assert count == (len(ODD) - 1 if name == "sampling" else len(ODD))
    plain = sorted(map(repr, run(odd.repartition(3)).collect()))
    assert plain == sorted(map(repr, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(odd, name):
    run = OPERATORS[name]
    assert len(run(clash(odd)).collect()) == len(run(odd).collect())


def test_stages_keep_columns_and_odd_rows(spark, odd):
    import corpus_pipeline

    docs = clash(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns
        kept.collect()
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.columns == docs.columns and empty.collect() == []


def test_word_places():
    got = words.find_words(pa.array(["a  bc\n", None, "", "d e f", " "]))
    text = bytes(got.data)
    assert [text[a:b].decode() for a, b in zip(got.starts, got.ends)] == ["a", "bc", "d e", "f"]
    assert got.first.tolist() == [0, 2, 2, 2, 4, 4]
    places, hashes = words.window_hashes(words.hash_words(got), got.first, 2)
    assert places.tolist() == [0, 2] and len(set(hashes)) == 2


def test_planes_and_buckets():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (exchange.from_planes(exchange.to_planes(keys, 8), 8) == keys).all()
    parts = list(exchange.bucket_ranges(keys, 7))
    assert [b for b, _, _ in parts] == sorted({b for b, _, _ in parts}) and sum(h - lo for _, lo, h in parts) == 1000


def test_sample_without_replacement_follows_the_model():
    model = spm_sampling.vocabulary(spm_sampling.MODEL, 1.0)
    text, n = "hello hello", 20_000
    row, draw, log, inclusion, ids = spm_sampling.sample(model, pa.array([text] * n), np.arange(n), 3)
    first, pairs, by_row = {}, {}, {}
    for r, d, p, s in zip(row, draw, log, map(tuple, ids.to_pylist())):
        by_row.setdefault(r, []).append((s, p))
        if d == 0:
            first[s] = first.get(s, 0) + 1
    prob = {s: math.exp(p) for own in by_row.values() for s, p in own}
    assert all(len({s for s, _ in own}) == 3 for own in by_row.values())
    for s, p in prob.items():  # the first draw follows the lattice
        assert abs(first.get(s, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3
    for own in by_row.values():
        pairs[own[0][0], own[1][0]] = pairs.get((own[0][0], own[1][0]), 0) + 1
    for a, b in itertools.permutations(sorted(prob, key=prob.get)[-4:], 2):  # the second, the rest of it
        p = prob[a] * prob[b] / (1 - prob[a])
        assert abs(pairs.get((a, b), 0) / n - p) < 5 * math.sqrt(p / n) + 2e-3


def test_all_segmentations_of_a_short_text():
    model = spm_sampling.vocabulary(spm_sampling.MODEL, 1.0)
    row, _, log, inclusion, ids = spm_sampling.sample(model, pa.array(["abc"]), np.array([5]), 100)
    pieces = [bytes(model.data[p : p + n]) for p, n in zip(model.places, model.lengths)]
    known = set(pieces)
    text = b" abc"
    cuts = [c for k in range(4) for c in itertools.combinations(range(1, 4), k)]
    want = {tuple(text[a:b] for a, b in zip((0, *c), (*c, 4))) for c in cuts}
    want = {parts for parts in want if known.issuperset(parts)}
    assert {tuple(pieces[i] for i in s) for s in ids.to_pylist()} == want
    assert math.isclose(np.exp(log).sum(), 1.0, rel_tol=1e-9) and (inclusion == 1).all()


def test_decoding(spark):
    docs = table(spark, [(1, "a ♞\n b"), (2, ""), (3, None), (4, " lead")])
    got = spm_sampling.decoded(spm_sampling.sampled(docs, draws=3)).collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, "a ♞\n b"), (2, ""), (3, ""), (4, " lead")}


def test_license_rules():
    cases = {
        "Licensed under the Apache License, Version 2.0 (the \"License\")": {"apache", "apache-2.0"},
        "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3.0-or-later"},
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
        "released under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
        "Released under the MIT License.": {"mit"},
        "mit der Lizenz": set(),
        "free and unencumbered software: This is free and unencumbered software released into the public domain": {"unlicense"},
        "": set(),
    }
    for text, labels in cases.items():
        assert set(filter(None, license_scan._row(text)[4].split(","))) == labels, text
    for text in ("CC   by, cc-BY éMIT-License mit license", "gnu general public\nlicense licenseé apache license"):
        r = license_scan._row(text)
        assert r[:4] == plain_licenses(text)[1:]
    table_ = license_scan.rule_table()
    assert len(table_) > 250


def test_suppression_matches_a_plain_version():
    text = ("licensed under the gnu general public license, version 3. mit license. cc by-sa 4.0 " * 40).strip()
    rules = license_scan._compiled()[0]
    accepted = []
    for rule, pattern in rules:
        if any(k in text for k in rule.keyword.split("|")):
            new = [m.span() for m in pattern.finditer(text)]
            accepted += [(a, b, rule.label, rule.confidence) for a, b in new if not any(x <= a and b <= y for x, y, *_ in accepted)]
    assert license_scan.scan_text(text)[0] == sorted(accepted)


def test_interpolation_weights():
    # Bucket 3: the bigram estimate is right; bucket 1: only the unigram knows the tokens.
    cells = np.array([[3, 1, 40, 1000], [1, 0, 5, 1000]])
    weights = lm_scoring.learn_weights(cells, 1000)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 1:] > 0).all() and weights[0, 0] == 0
    assert weights[3, 0] > 0.95 and weights[1, 1] > 0.95 and np.allclose(weights[2], weights[1])


def test_language_model_without_training_documents(spark):
    got = lm_scoring.scored(table(spark, [(i, "a b") for i in range(200) if remainder(i, 7) == 2])).collect()
    assert got and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_vantage_trees_lose_no_pair():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 3000).astype(np.uint64)
    near = base[:800] ^ (np.uint64(1) << draw.integers(0, 64, 800).astype(np.uint64)) ^ (
        np.uint64(1) << draw.integers(0, 64, 800).astype(np.uint64))
    prints = np.unique(np.concatenate((base, near)))
    nodes = simhash_dedup.grow(prints[::7], 20)
    leaf, place = simhash_dedup.route(nodes, prints)
    assert len(nodes) > 5 and len(np.unique(leaf)) > 5
    homes = {}
    for a, b in zip(leaf, place):
        homes.setdefault(int(b), set()).add(int(a))
    i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    assert len(i) > 500 and all(homes[int(a)] & homes[int(b)] for a, b in zip(i, j))
    member, smallest = simhash_dedup.local_links(prints)
    assert set(np.concatenate((prints[i], prints[j]))) <= set(member) | set(smallest)


def test_components_over_many_shards(spark):
    draw = np.random.default_rng(5)
    chain = [int(draw.integers(0, 2**63))]
    for k in range(60):  # a chain of neighbours, far apart at its ends
        chain.append(chain[-1] ^ (1 << (k % 62)))
    others = [int(x) for x in draw.integers(0, 2**63, 3000)]
    rows = table(spark, [(x,) for x in chain + others], "fp bigint")
    spread = simhash_dedup.sharded(rows, shard=200, sample=2000)
    assert spread.select("shard").distinct().count() > 10
    edges = spread.groupBy("shard").applyInArrow(simhash_dedup._shard_links, "fp bigint, root bigint").distinct()
    roots = {r.fp: r.root for r in simhash_dedup.rooted(edges).collect()}
    top = min(chain)
    assert all(roots.get(x, x) == top for x in chain)


def test_group_of_near_copies(spark):
    base = [" ".join(WORDS * 6 + [f"w{k}" for k in range(n, n + 3)]) for n in range(3)]
    rows = [(i, base[i % 3] if i % 2 else base[0]) for i in range(40)] + [(100, "other words here now")]
    got = {r.doc_id: r.component_id for r in simhash_dedup.components(table(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows).items()}
    assert {r.doc_id for r in simhash_dedup.deduplicated(table(spark, rows)).collect()} == set(got.values())


def test_repeats_over_chunks(spark, monkeypatch):
    draw = np.random.default_rng(9)
    pool = [f"w{k}" for k in range(400)]
    shared = [" ".join(draw.choice(pool, 40)) for _ in range(5)]
    rows = [(i, " ".join([*draw.choice(pool, 30), shared[i % 5], *draw.choice(pool, 17)])) for i in range(120)]
    rows += [(500, shared[0] + " " + shared[0]), (501, shared[1][5:])]
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 4096)
    monkeypatch.setattr(exchange.chunked, "__defaults__", (4096, None))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed_repeats(table(spark, rows)).collect()}
    assert got == plain_substring_dedup(rows)
    scores = lm_scoring.scored(table(spark, rows)).collect()
    monkeypatch.setattr(exchange.chunked, "__defaults__", (1 << 22, None))
    whole = {r.doc_id: r.score for r in lm_scoring.scored(table(spark, rows)).collect()}
    assert all(r.score == pytest.approx(whole[r.doc_id], rel=1e-6) for r in scores)


def test_lines(spark):
    a, b = WORDS[:6], WORDS[6:12]
    rows = [
        (1, "\n".join(a)), (2, "\n".join(["x", *a[1:5], "y"])), (3, "\n".join(a[:2] + b)), (4, "\n".join(b[:3] * 2)),
        (5, "\n".join(["", *a, "", "tail"])), (6, "same\nsame\nsame\nsame\nsame"), (7, None),
    ]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.report(table(spark, rows)).collect()}
    assert got == plain_line_dedup(rows)
    kept = {r.doc_id: r for r in line_dedup.deduplicated(table(spark, [(*r, "en", "s", 1) for r in rows], DOCS)).collect()}
    assert 5 in kept and kept[5].text.split() == ["tail"] and kept[5].n_chars == len(kept[5].text)


def test_decontamination(spark):
    item = " ".join(WORDS)
    docs = [(1, "before. " + item.upper().replace(" ", ", ") + " after"), (2, " ".join(WORDS[:12])), (3, None), (4, "tiny item"),
            (5, " ".join(WORDS[:-2]) + " other end"), (6, "a tiny item"), (None, item), (7, "tiny long text of words with a tiny, ITEM in it"), (8, "item tiny and more words here")]
    items = [(1, item), (2, "Tiny item!"), (3, ""), (4, None)]
    got = decontamination.contained_items(table(spark, docs), table(spark, items, "item_id bigint, text string"))
    n = len(WORDS) - 4
    assert {(r.doc_id, r.item_id, r.shared_shingles) for r in got.collect()} == {(1, 1, n), (4, 2, 1), (5, 1, n - 2), (6, 2, 1), (7, 2, 1)}
    clean = decontamination.clean_documents(table(spark, docs), table(spark, items, "item_id bigint, text string"))
    assert sorted((r.doc_id for r in clean.collect()), key=str) == [2, 3, 8]


def test_signatures_are_long_enough(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(k + 4))) for k in range(1, 70)]
    got = decontamination.signatures(table(spark, items, "item_id bigint, text string")).collect()
    for k in range(1, 70):
        own = [r for r in got if r.item_id == k]
        assert len(own) >= k - math.ceil(0.8 * k) + 1 or len(own) == k
        assert {r.size_class for r in own} == {int(math.log2(k))}


PAGES = "page_id bigint, url string, html string"


def test_archives(spark):
    long = "p" * 120
    tricky = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "\nWARC/1.1\r\n"
    pages = [(1, "http://a\r\nX: y", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
             (7, "u", tricky), (8, "u", tricky), (9, "u", long + "\r\n\r\n"), (10, "u", "é" * 60), (None, "u", long)]
    from foliolake.llm.common import shared_folder

    folder = shared_folder(spark, "test")
    got = warc.archived_pages(table(spark, pages, PAGES), folder).collect()
    import hashlib

    first = {}
    for i, _, h in pages:
        if i is not None:
            first.setdefault((h or ""), i)
    want = set()
    for i, _, h in pages:
        body = (h or "").encode()
        again = len(body) >= 100 and first[h or ""] != i
        want.add((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert {tuple(r) for r in got} == want and len(got) == len(pages)
    back = warc.read_records(spark, folder).collect()
    assert all(r.complete for r in back)
    assert {r.page_id: r.payload for r in back if r.record_type == "response"}[7] == tricky
    assert warc.archived_pages(table(spark, [], PAGES)).collect() == []


def test_classifier_without_labels(spark, odd, none):
    labels = table(spark, [], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_classifier.classified(odd, labels).collect()} == {0.5}
    one = table(spark, [(7, 1, 0), (8, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_classifier.classified(odd, one).collect()} <= {0.5, 1.0}
    assert quality_classifier.classified(none, labels).collect() == []


def test_classifier_is_no_copy_of_labels(spark):
    good = [(i, " ".join(np.random.default_rng(i).choice(WORDS, 60))) for i in range(300)]
    bad = [(1000 + i, "!!! $$$ " * 20 + str(i)) for i in range(300)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    got = quality_classifier.classified(table(spark, good + bad), table(spark, labels, "doc_id bigint, quality int, toxic int"))
    held = [(r.doc_id < 1000, r.predicted) for r in got.collect() if r.held_out]
    assert held and all(int(a) == b for a, b in held)


def test_isotonic_is_monotone():
    draw = np.random.default_rng(2)
    n = draw.integers(0, 5, 200).astype(float)
    ones = np.minimum(n, draw.integers(0, 5, 200))
    curve = quality_classifier.isotonic(n, ones)
    assert (np.diff(curve) >= -1e-12).all() and math.isclose((curve * n).sum(), ones.sum(), rel_tol=1e-9)


def test_quality_rules_columns(spark):
    docs = table(spark, [(1, " ".join(WORDS * 2) + ".", "en", "s", 5), (2, "*** " * 30, "en", "s", 5), (3, None, "en", "s", None)], DOCS)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    judged = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert judged[3].failed_rules[0] == "words" and judged[3].n_words == 0
    assert judged[2].n_repeat_words == 30 and judged[2].base_failed
