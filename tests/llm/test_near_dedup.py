"""The near-duplicate stage against all pairs by their exact Jaccard similarity."""

import numpy as np

import corpus_pipeline
from foliolake.llm import near_dedup, simhash_dedup
from tests.llm.helpers import SPACE, lower

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = SPACE.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(rows):
    """{doc_id: smallest doc_id reachable} over all pairs of similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 100 * both >= 80 * all_:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_stage_equals_all_pairs(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = plain_groups(rows)
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, documents, SF).collect()}
    assert got == {i for i, c in want.items() if i == c} and len(got) < len(rows)


def test_edited_copies_chains_and_groups(spark):
    draw = np.random.default_rng(11)
    pool = [f"w{k}" for k in range(3000)]
    base = list(draw.choice(pool, 120))
    rows = [(1, " ".join(base)), (2, " ".join(["new", *base[1:60], "other", *base[61:]]))]
    step = list(base)
    for k in range(3, 40):  # a chain whose ends are far apart
        step = [*step[6:], *draw.choice(pool, 6)]
        rows.append((k, " ".join(step)))
    seed = list(draw.choice(pool, 200))
    for k in range(100, 160):  # a group around one text
        own = list(seed)
        for place in draw.integers(0, 200, 3):
            own[place] = f"edit{k}x{place}"
        rows.append((k, " ".join(own)))
    rows += [(200, None), (201, ""), (202, "Two words"), (203, "two  WORDS"), (204, "two other words")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.components(table).collect()}
    assert got == plain_groups([r for r in rows if r[0] < 200 or r[0] > 201]) | {200: 200, 201: 200}


def test_vantage_points_bring_near_fingerprints_together(spark, monkeypatch):
    """The search of fingerprints finds near copies by itself, and what it finds is checked on whole sets."""
    draw = np.random.default_rng(5)
    pool = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(40):
        base = list(draw.choice(pool, 900))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:450], "edit", *base[451:]]))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = [simhash_dedup.fingerprint(t) for _, t in rows]
    near = {2 * k for k in range(40) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= simhash_dedup.RADIUS}
    assert len(near) > 20
    # No two texts share a band.
    monkeypatch.setattr(near_dedup, "band_hashes", lambda sets: np.array([[near_dedup._node(s)] * 25 for s in sets], np.uint64))
    got = {r.doc_id: r.component_id for r in near_dedup.components(table).collect()}
    assert {i for i in range(0, 80, 2) if got[i + 1] == i} == near


def test_rows_of_one_id_are_judged_each_by_its_text(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "something else that nobody wrote before"), (None, "a b c d e f g h")]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
