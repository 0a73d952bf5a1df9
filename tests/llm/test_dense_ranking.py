"""Ranked search by dense products against a plain ranking."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from foliolake.llm import dense_ranking, queries
from tests.llm.helpers import lower

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(docs, items, k=10):
    counts = [(i, Counter(map(lower, TERM.findall(t or "")))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for (doc, c), n in zip(counts, lengths):
            score = 0
            for term in {lower(t) for t in TERM.findall(text or "")} & set(c):
                m = 10 + 90 * n * n_docs // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=str)


def ranks(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_equals_the_plain_ranking(spark):
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, "text").collect()]
        for name, key in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    got = ranks(queries.op13_ranked_lexical_search(spark, SF))
    assert got == plain_ranks(docs, items) and len(got) > len(items)


@pytest.mark.parametrize("pairs", [5, 1 << 19])
def test_odd_rows_ties_and_blocks_of_items(spark, pairs, monkeypatch):
    docs = [(k, "same words here" if k % 3 else f"Same  THING-{k % 4} é", 1) for k in range(40, 0, -1)]
    docs += [(None, "same words here", 1), (None, None, 1), (90, "", 1), (91, "--- ##", 1), (92, "long " * 40000 + "words", 1)]
    docs += docs[:3]
    items = [(1, "same words"), (1, "same words"), (1, "THING 3"), (2, None), (3, "absent"), (None, "é long"), (4, "words Words here")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, score int")
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, rank string")
    got = ranks(dense_ranking.ranked(table, asked, pairs=pairs))
    assert got == plain_ranks([d[:2] for d in docs], items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert dense_ranking.ranked(docs.limit(0), items).collect() == []
    assert dense_ranking.ranked(docs, items.limit(0)).collect() == []


def test_tiles_are_exact_and_keep_ties():
    weight = np.full(3000, 40_000, np.int64)
    assert dense_ranking.tile_terms(40_000) * 40_000 * 10**6 < 1 << 53
    assert dense_ranking.tile_terms(10**8) * 10**8 * 10**6 < 1 << 53
    tiles = dense_ranking.ItemTiles([np.arange(3000), np.array([2999])], weight)
    places, rows = np.tile(np.arange(3000), 2), np.repeat([0, 1], 3000)
    impact = np.full(6000, 40_000 * 999_999.0)
    assert tiles.scores(0, places, rows, impact, 2).tolist() == [[3000 * 40_000 * 999_999] * 2, [40_000 * 999_999] * 2]
    best = dense_ranking.Best(1, 2)
    best.add(0, np.array([[5, 7, 5]]), np.array([9, 8, 4]), np.array([False, False, False]))
    best.add(0, np.array([[5, 5, 0]]), np.array([3, 6, 1]), np.array([True, False, False]))
    assert [(int(r["score"]), int(r["id"])) for r in best.rows] == [(7, 8), (5, 4)]
