"""A task of the language model holds little beside a chunk's tokens, and is sent no counts that it does not use."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from foliolake.llm import exchange, lm_scoring


@pytest.fixture(scope="module")
def chunk():
    """Three megabytes of text, like half of a chunk."""
    draw = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(40_000)])
    texts = [" ".join(words[(draw.pareto(1.0, 500) * 20).astype(int) % len(words)]) for _ in range(1500)]
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_bytes_per_token(chunk):
    key, n = (pa.scalar(3, pa.int32()),), sum(len(t.split()) + 1 for t in chunk["text"].to_pylist())
    asked, asking = peak(lambda: lm_scoring._ask(1)(key, chunk))
    bucket = (pa.scalar(0, pa.int32()),)
    answers, answering = peak(lambda: lm_scoring._answer(bucket, asked))
    answers = answers.filter(pa.compute.greater_equal(answers["chunk"], 0))
    _, telling = peak(lambda: lm_scoring._histogram(1, n)(key, chunk, answers))
    weights = np.full((lm_scoring.BUCKETS, 3), 1 / 3)
    _, scoring = peak(lambda: lm_scoring._score(1, weights, 1000, n)(key, chunk, answers))
    assert max(asking, answering, telling, scoring) < 80 * n


def test_only_deleted_chunks_are_told_retained_counts(chunk):
    asked = [lm_scoring._ask(1)((pa.scalar(i, pa.int32()),), chunk.slice(400 * i, 400)) for i in range(2)]
    told = lm_scoring._answer((pa.scalar(0, pa.int32()),), pa.concat_tables(asked)).to_pylist()
    kept = {r["chunk"]: r.get("kept") for r in told}
    training = {r["chunk"]: exchange.from_planes(r["payload"], lm_scoring.COUNT_BYTES) for r in told}
    assert kept[0] == kept[-1] == b"" and len(exchange.from_planes(kept[1], lm_scoring.COUNT_BYTES)) == len(training[1])
    assert (exchange.from_planes(kept[1], lm_scoring.COUNT_BYTES) <= training[1]).all()
