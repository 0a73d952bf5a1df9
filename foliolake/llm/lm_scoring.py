"""Language-model scores by deleted interpolation.

A text is its words (A-Z in lower case) and one end token. The model mixes three estimates of a token:
its bigram and unigram maximum-likelihood estimates and a uniform one over the training vocabulary and one
unknown word. The weights depend on how often the context was seen (one bucket per power of two) and are
learned by expectation-maximisation: one fold of the training documents is deleted from the counts, and the
weights that make that fold likeliest under the other folds' counts are kept. Scores then use the counts of
all training documents.

Counts are gathered over all documents through ``exchange``: a chunk of text sends each distinct unigram and
bigram once, with its counts, and gets the corpus counts back. For the weights, the deleted fold is reduced
to a histogram over (context bucket, bigram estimate, unigram estimate) whose bins are a quarter of a
power of two wide; its size is bounded by the bins, whatever the corpus, and it covers every token of the fold.

Documents whose crc32(doc_id as text) mod 7 is ``HELD_OUT`` are scored but never counted; those with
``DELETED`` form the deleted fold. Words are told apart by 63-bit hashes.

Defined results: null and empty texts are one end token. A null doc_id counts as training. Without training
documents every estimate is uniform over the unknown word alone and scores are zero. Rows that share a
doc_id are scored each on its own. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm import exchange
from foliolake.llm.common import text_slices, written
from foliolake.llm.words import find_words, hash_words, mix

FOLDS, HELD_OUT, DELETED = 7, 2, 3
STEPS = 4  # histogram bins per power of two
BUCKETS = 48
ROUNDS = 60
#: Bytes of a count on its way; ``to_planes`` refuses a count that needs more (281 million million).
COUNT_BYTES = 6
_END = np.uint64(0x5851F42D4C957F2D)
_CONTEXT = np.uint64(0xA0761D6478BD642F)
_ONE = np.uint64(1)

#: Bytes of text that are split into words at once, and tokens that are looked up at once; a task holds some fifty bytes
#: for every token of a chunk, and what a slice needs beside them.
SLICE_BYTES, SLICE_TOKENS = 1 << 20, 1 << 17
#: The answers are written and read in row groups of this size: a task that reads them holds one whole.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "4"}

ANSWER = "chunk int, payload binary, kept binary, bucket int, types bigint, tokens bigint, retained bigint"


def _folds(table: pa.Table) -> np.ndarray:
    ids = table["doc_id"].to_pylist()
    return np.array([zlib.crc32(str(i).encode()) % FOLDS if i is not None else 0 for i in ids], np.int64)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, and where texts begin."""
    tokens, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for batch in table.select(["text"]).to_batches():
        for part in text_slices(batch, SLICE_BYTES):
            words = find_words(part.column("text"), lower=True)
            tokens.append(np.insert(hash_words(words), words.first[1:], _END))
            sizes.append(np.diff(words.first) + 1)
    return np.concatenate(tokens), np.cumsum(np.concatenate(sizes))


def _unigrams(tokens: np.ndarray) -> np.ndarray:
    """Even keys."""
    return (tokens >> _ONE) << _ONE


def _bigrams(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
    """Odd keys of the tokens from ``low`` on with those before them. The end token stands before every text."""
    before = tokens[low - 1 : high - 1] if low else np.concatenate(([_END], tokens[: high - 1]))
    return mix(before * _CONTEXT + tokens[low:high]) | _ONE


def _slices(tokens: np.ndarray) -> Iterator[tuple[int, int]]:
    for low in range(0, len(tokens), SLICE_TOKENS):
        yield low, min(low + SLICE_TOKENS, len(tokens))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts ``keys`` in place; its distinct ones and how often each occurs."""
    keys.sort()
    starts = exchange.groups(keys)
    return keys[starts], np.diff(starts, append=len(keys))


def _keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct unigram and bigram keys, sorted, and how often each occurs."""
    n = len(tokens)
    keys = np.empty(2 * n, np.uint64)
    for low, high in _slices(tokens):
        keys[low:high] = _unigrams(tokens[low:high])
        keys[n + low : n + high] = _bigrams(tokens, low, high)
    return _distinct(keys)


def _ask(buckets: int):
    """Per chunk: its distinct unigrams and bigrams with their counts in training documents."""

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        tokens, begin = _tokens(table)
        held = np.repeat(_folds(table) == HELD_OUT, np.diff(begin))
        keys, counts = _keys(tokens)
        for low, high in _slices(tokens):
            for own in (_unigrams(tokens[low:high]), _bigrams(tokens, low, high)):
                np.subtract.at(counts, np.searchsorted(keys, np.sort(own[held[low:high]])), 1)
        rows = [
            (b, chunk, exchange.to_planes(keys[low:high], 8), exchange.to_planes(counts[low:high], COUNT_BYTES))
            for b, low, high in exchange.bucket_ranges(keys, buckets)
        ]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "chunk", "keys", "payload"]
        )

    return ask


def _packed(column: pa.ChunkedArray) -> list[pa.Buffer]:
    """The values of a binary column, which are not copied."""
    return [value.as_buffer() for value in column]


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Per chunk, training counts of what it asked and, for the deleted fold's chunks, retained ones; and one row of totals."""
    chunks = table["chunk"].to_pylist()
    asked, counts = _packed(table["keys"]), _packed(table["payload"])
    keys, _ = _distinct(np.concatenate([exchange.from_planes(k, 8) for k in asked]))
    total, retained = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    places = []
    for chunk, own, seen in zip(chunks, asked, counts):
        at = np.searchsorted(keys, exchange.from_planes(own, 8))  # a chunk asks once for each key
        n = exchange.from_planes(seen, COUNT_BYTES).astype(np.int64)
        total[at] += n
        if chunk % 2 == 0:
            retained[at] += n
        places.append(at.astype(np.int32))
    payload = [exchange.to_planes(total[at], COUNT_BYTES) for at in places]
    kept = [exchange.to_planes(retained[at], COUNT_BYTES) if chunk % 2 else b"" for chunk, at in zip(chunks, places)]
    word = (keys & _ONE) == 0
    n = len(chunks)
    return pa.table(
        [
            pa.array([*chunks, -1], pa.int32()),
            pa.array([*payload, b""], pa.binary()),
            pa.array([*kept, b""], pa.binary()),
            pa.array([key[0].as_py()] * (n + 1), pa.int32()),
            pa.array([None] * n + [int((total[word] > 0).sum())], pa.int64()),
            pa.array([None] * n + [int(total[word].sum())], pa.int64()),
            pa.array([None] * n + [int(retained[word].sum())], pa.int64()),
        ],
        names=["chunk", "payload", "kept", "bucket", "types", "tokens", "retained"],
    )


def _counts(tokens: np.ndarray, answers: pa.Table, column: str, buckets: int):
    """By slices: where it is, and the answered counts of each token's unigram, bigram and context."""
    keys, _ = _keys(tokens)
    values = np.empty(len(keys), np.int64)
    told = dict(zip(answers["bucket"].to_pylist(), _packed(answers[column])))
    for bucket, low, high in exchange.bucket_ranges(keys, buckets):
        values[low:high] = exchange.from_planes(told[bucket], COUNT_BYTES)
    odd = (keys & _ONE) == _ONE
    pairs, pair_counts = keys[odd], values[odd]
    words, word_counts = keys[~odd], values[~odd]
    del keys, values, odd
    # The context of a token is the unigram before it.
    before = word_counts[np.searchsorted(words, _unigrams(np.array([_END])))]
    for low, high in _slices(tokens):
        unigram = word_counts[np.searchsorted(words, _unigrams(tokens[low:high]))]
        bigram = pair_counts[np.searchsorted(pairs, _bigrams(tokens, low, high))]
        yield slice(low, high), unigram, bigram, np.concatenate((before, unigram[:-1]))
        before = unigram[-1:]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for zero, else one more than the place of ``p`` on the logarithmic scale."""
    logs = np.log2(p, out=np.zeros(len(p)), where=p > 0)
    return np.where(p > 0, 1 + np.rint(-STEPS * logs).astype(np.int64), 0)


def _histogram(buckets: int, retained_tokens: int):
    def histogram(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        found, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, unigram, bigram, context in _counts(_tokens(table)[0], answers, "kept", buckets):
            p2, p1 = _bin(_ratio(bigram, context)), _bin(_ratio(unigram, float(retained_tokens)))
            distinct, counts = np.unique((_bucket(context) << 32) + (p2 << 16) + p1, return_counts=True)
            found.append(distinct)
            times.append(counts)
        distinct, of = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, of, np.concatenate(times))
        cells = (distinct >> 32, (distinct >> 16) & 0xFFFF, distinct & 0xFFFF, counts)
        return pa.table([pa.array(c, pa.int64()) for c in cells], names=["bucket", "p2", "p1", "n"])

    return histogram


def learn_weights(cells: np.ndarray, types: int) -> np.ndarray:
    """(bucket, 3) weights of bigram, unigram and uniform estimates by expectation-maximisation.

    ``cells`` has the columns bucket, bigram bin, unigram bin, count. Each weight starts from one
    pseudo-count, so none becomes zero, except the bigram's where the context was never seen.
    """
    bucket, counts = cells[:, 0], cells[:, 3].astype(float)
    p = np.stack(
        [np.where(cells[:, 1 + k] > 0, 2.0 ** (-(cells[:, 1 + k] - 1) / STEPS), 0.0) for k in (0, 1)]
        + [np.full(len(cells), 1.0 / (types + 1))], axis=1
    )
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    for _ in range(ROUNDS):
        shares = weights[bucket] * p
        shares *= (counts / shares.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, shares[:, k], BUCKETS) for k in range(3)], axis=1) + 1.0
        total[0, 0] = 0.0
        weights = total / total.sum(axis=1, keepdims=True)
    seen = np.bincount(bucket, minlength=BUCKETS) > 0
    for b in range(2, BUCKETS):  # a bucket without evidence takes its lower neighbour's weights
        if not seen[b]:
            weights[b] = weights[b - 1]
    return weights


def _score(buckets: int, weights: np.ndarray, types: int, tokens: int):
    def score(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        of_texts, begin = _tokens(table)
        known, base_logs, logs = np.empty(len(of_texts), bool), np.empty(len(of_texts)), np.empty(len(of_texts))
        for at, unigram, bigram, context in _counts(of_texts, answers, "payload", buckets):
            mixed = weights[_bucket(context)]
            p = mixed[:, 0] * _ratio(bigram, context) + mixed[:, 1] * _ratio(unigram, float(tokens))
            p += mixed[:, 2] / (types + 1)
            known[at], base_logs[at], logs[at] = unigram > 0, np.log10(unigram + 1.0), np.log10(p)
        sums = lambda x: np.add.reduceat(x, begin[:-1], dtype=np.result_type(x, np.int64))  # noqa: E731  every text has its end token
        n = np.diff(begin)
        base = sums(base_logs) - n * np.log10(tokens + types + 1.0)
        return pa.table(
            {
                "doc_id": table["doc_id"].combine_chunks().cast(pa.int64()),
                "held_out": pa.array(_folds(table) == HELD_OUT),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(sums(known), pa.int64()),
                "train_tokens": pa.array(np.full(len(n), tokens), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(sums(logs)),
            }
        )

    return score


SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def scored(docs: DataFrame) -> DataFrame:
    """Scores of all documents under the model learned from the training ones."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    deleted = F.coalesce((fold == DELETED).cast("int"), F.lit(0))
    parts, chunks = exchange.chunked(docs, kind=deleted)
    asked = parts.groupBy("chunk").applyInArrow(_ask(chunks), exchange.QUESTION)
    answers = written(asked.groupBy("bucket").applyInArrow(_answer, ANSWER), "counts", options=GROUPS)
    totals = answers.filter("chunk = -1").agg(*(F.sum(c) for c in ("types", "tokens", "retained"))).first()
    types, tokens, retained = (int(x or 0) for x in totals)
    odd = parts.filter(deleted == 1)
    kept = answers.filter("chunk >= 0 AND chunk % 2 = 1").select("chunk", "bucket", "kept")
    cells = odd.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(
        _histogram(chunks, retained), "bucket bigint, p2 bigint, p1 bigint, n bigint"
    )
    rows = cells.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(rows.to_numpy(dtype=np.int64).reshape(-1, 4), types)
    if not tokens:
        weights[:] = (0.0, 0.0, 1.0)
    told = answers.filter("chunk >= 0").select("chunk", "bucket", "payload")
    return parts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _score(chunks, weights, types, tokens), SCHEMA
    )
