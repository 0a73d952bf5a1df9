"""MinHash near-dedup by tensored banding, and the links inside its tables, against all pairs."""

import numpy as np
import pytest

from foliolake.llm import minhash_dedup, near_dedup, queries, table_links
from tests.llm.helpers import SPACE, lower

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    words = SPACE.findall(lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def plain_groups(rows, width, percent):
    """{doc_id: (set size, smallest doc_id reachable)} over all pairs; empty sets are linked with nothing."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op11_minhash_near_dedup(spark, SF).collect()}
    want = plain_groups(rows, 3, 85)
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [
        (5, text, 1), (3, text.upper(), 1), (None, text + " more", 1), (5, text, 1), (7, None, 1), (8, " \n\t", 1), (9, "", 1),
        (10, "Two words", 1), (11, "two  WORDS", 1), (12, "two", 1), (None, "alone here", 1), (13, "y " * 30000, 1), (14, "y y y", 1),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    got = sorted(map(tuple, minhash_dedup.components(table).collect()), key=str)
    assert got == sorted(
        [
            (5, 58, 3, False), (3, 58, 3, True), (None, 59, 3, False), (5, 58, 3, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
            (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True), (None, 1, None, True), (13, 1, 13, True), (14, 1, 13, False),
        ],
        key=str,
    )
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash_dedup.components(empty).collect() == []


@pytest.fixture
def compared(monkeypatch):
    """Counts the pairs whose sets are compared."""
    counts = []
    inner = table_links.similar_pairs

    def counting(pairs, sets, percent):
        counts.append(pairs.count())
        return inner(pairs, sets, percent)

    monkeypatch.setattr(table_links, "similar_pairs", counting)
    return counts


def group(core, own, n, draw, texts=1):
    """``n`` texts with a common core of words and ``own`` words of their own, at one place of it."""
    base = [f"c{k}" for k in range(core)]
    for _ in range(n):
        yield " ".join([*base[: core // 2], *(f"o{draw.integers(1 << 40)}" for _ in range(own)), *base[core // 2 :]])


def test_members_that_only_share_a_core_are_not_paired(spark, compared):
    draw = np.random.default_rng(1)
    rows = list(enumerate(group(200, 48, 800, draw)))  # 196 of some 296 shingles in common: two thirds
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.components(table).collect()}
    assert got == {i: i for i, _ in rows}
    assert sum(compared) <= 20 * len(rows)


def test_a_group_of_near_copies_is_linked_by_few_pairs(spark, compared):
    draw = np.random.default_rng(2)
    rows = list(enumerate(group(400, 12, 800, draw)))  # 392 of some 430 shingles in common: nine tenths
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.components(table).collect()}
    assert got == {i: 0 for i, _ in rows}
    assert sum(compared) <= 20 * len(rows)


def test_prefixes_lose_no_pair_near_the_threshold(spark):
    draw = np.random.default_rng(4)
    pool = [f"w{k}" for k in range(400)]
    rows = []
    for seed in range(12):
        base = list(draw.choice(pool, 60))
        for _ in range(12):
            own = list(base)
            for place in draw.integers(0, 60, draw.integers(0, 5)):
                own[place : place + 1] = list(draw.choice(pool, draw.integers(0, 3)))
            rows.append((len(rows), " ".join(own)))
    sets = [np.array(sorted(hash(s) & ((1 << 62) - 1) for s in shingles(t, 3)), np.uint64) for _, t in rows]
    nodes = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for (i, _), s in zip(rows, sets)], "node bigint, root bigint, shingles binary")
    none = spark.createDataFrame([], "fp bigint, root bigint")
    linked = table_links.prefix_links(nodes.select("node", "root"), nodes.select("node", "shingles"), none, 85)
    root = {i: i for i, _ in rows}
    for r in linked.collect():
        a, b = sorted((root[r.fp], root[r.root]))
        root = {i: a if x == b else x for i, x in root.items()}
    assert root == {i: c for i, (_, c) in plain_groups(rows, 3, 85).items()}


def test_prefix_lengths_are_enough():
    for percent in (80, 85):
        for small in range(1, 60):
            index = table_links.prefix_lengths(small, percent)[0]
            for large in range(small, 2 * small):
                probe = table_links.prefix_lengths(large, percent)[1]
                need = -(-percent * (small + large) // (100 + percent))
                if need <= small:
                    assert small - need + 1 <= index and large - need + 1 <= probe


def test_half_hashes_meet_as_similar_sets_do():
    draw = np.random.default_rng(9)
    met = 0
    for _ in range(200):
        values = draw.integers(0, 1 << 63, 230, dtype=np.uint64)
        a, b = minhash_dedup.half_hashes([values[:213], values[17:]])  # 196 of 230 in common
        same = a == b
        met += same[: minhash_dedup.HALVES].any() and same[minhash_dedup.HALVES :].any()
    assert met == 200


def test_parity_never_counts_more_than_what_differs():
    draw = np.random.default_rng(6)
    for n in (1, 30, 300, 5000):
        values = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = values[: n - n // 4], values[n // 8 :]
        differing = int(np.bitwise_count((table_links.parity_words(a) ^ table_links.parity_words(b)).view(np.uint64)).sum())
        assert differing <= len(np.setxor1d(a, b))


def test_short_texts_with_words_left_out_are_not_paired(spark, compared):
    """All share most of a core of 40 words, yet no two are similar enough."""
    core = [f"c{k}" for k in range(40)]
    rows = [(n, " ".join(w for k, w in enumerate(core) if k not in (i, j))) for n, (i, j) in enumerate((i, j) for i in range(3, 37) for j in range(i + 5, 37, 3))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.components(table).collect()}
    assert got == plain_groups(rows, 3, 85)
    assert sum(compared) <= 20 * len(rows)
