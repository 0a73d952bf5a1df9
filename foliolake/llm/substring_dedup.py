"""Substring dedup with fixed-block anchors.

A word is removed when it lies in a window of 13 consecutive words that also starts in a document with a
smaller doc_id. Windows are judged on the input.

Method. Every document is a reference: its non-overlapping blocks of seven words are the index, and every
rolling window of seven words, of every document, probes it. A 13-word window always contains a whole block
of its reference, so each repeat is anchored by a hit. Hits are extended to both sides: the 13-word windows
around an anchor are compared with those around the other places of the same anchor, and neighbouring
repeated windows join into maximal repeats. Both comparisons go through ``exchange``: per chunk of text one
entry per distinct window, so a passage shared by a third of all documents is neither gathered nor paired.

Anchors compare 48 bits and windows 64 bits of hashes; a window counts as repeated only if its own hash is.

Defined results: null and empty texts have no words and the digest of the empty string. Rows that share a
doc_id do not remove each other's words. A null doc_id is larger than every number, and rows with null ids
do not remove each other's words. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliolake.llm import exchange
from foliolake.llm.words import find_words, hash_words, window_hashes

WINDOW = 13
BLOCK = 7
KEY_BITS = np.uint64(16)
LAST = np.iinfo(np.int64).max


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _anchors(words, block: int) -> np.ndarray:
    """Sorted 48-bit keys of rolling windows, with bit 0 set where the window is a block."""
    places, hashes = window_hashes(hash_words(words), words.first, block)
    aligned = (places - words.first[:-1][words.text_of()[places]]) % block == 0
    return ((hashes >> KEY_BITS) << KEY_BITS) | aligned.astype(np.uint64)


def _questions(chunk: int, buckets: int, keys: np.ndarray, payload: np.ndarray, key_width: int, width: int) -> pa.Table:
    rows = [
        (bucket, chunk, exchange.to_planes(keys[low:high] >> np.uint64(64 - 8 * key_width), key_width),
         exchange.to_planes(payload[low:high], width))
        for bucket, low, high in exchange.bucket_ranges(keys, buckets)
    ]
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.table(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
         pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
        names=["bucket", "chunk", "keys", "payload"],
    )


def _answers(chunks, bucket: int, keys, payloads) -> pa.Table:
    n = len(chunks)
    return pa.table(
        [pa.array(chunks, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(keys, pa.binary()),
         pa.array(payloads, pa.binary())],
        names=["chunk", "bucket", "keys", "payload"],
    )


def _ask_anchors(buckets: int, block: int):
    """Per chunk: its distinct anchors; payload bit 0 tells of a block, bit 1 of several places."""

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        marked = np.sort(_anchors(find_words(table["text"]), block))
        keys = (marked >> KEY_BITS) << KEY_BITS
        begin = exchange.groups(keys)
        end = np.append(begin[1:], len(keys)) if len(begin) else begin
        payload = (marked[end - 1] & np.uint64(1)) | ((end - begin > 1).astype(np.uint64) << np.uint64(1))
        return _questions(key[0].as_py(), buckets, keys[begin], payload, 6, 1)

    return ask


def _answer_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Per chunk, the bits of the anchors that have a block and more than one place in the corpus."""
    asked = [exchange.from_planes(k, 6) for k in table["keys"].to_pylist()]
    payload = np.concatenate([np.frombuffer(p, np.uint8) for p in table["payload"].to_pylist()])
    distinct, place, count = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    block, several = np.zeros(len(distinct), bool), count > 1
    block[place[(payload & 1) > 0]] = True
    several[place[(payload & 2) > 0]] = True
    hits = np.split((block & several)[place], np.cumsum([len(k) for k in asked])[:-1])
    return _answers(
        table["chunk"].to_pylist(), key[0].as_py(), [b""] * len(asked), [np.packbits(h).tobytes() for h in hits]
    )


def _ask_windows(buckets: int, block: int, window: int):
    """Per chunk: the distinct windows that contain a hit anchor, each with its smallest doc_id."""

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        words = find_words(table["text"])
        marked = _anchors(words, block)
        keys = (marked >> KEY_BITS) << KEY_BITS
        distinct = np.unique(keys)
        hit = np.zeros(len(distinct), bool)
        bits = dict(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()))
        for bucket, low, high in exchange.bucket_ranges(distinct, buckets):
            hit[low:high] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=high - low).astype(bool)
        anchored = np.zeros(len(words.starts) + 1, np.int64)
        places, _ = window_hashes(np.zeros(len(words.starts), np.uint64), words.first, block)
        anchored[places + 1] = hit[np.searchsorted(distinct, keys)]
        before = np.cumsum(anchored)  # hits at places smaller than the index
        places, hashes = window_hashes(hash_words(words), words.first, window)
        near = before[places + window - block + 1] > before[places]
        places, hashes = places[near], hashes[near]
        ids = _ids(table)[words.text_of()[places]]
        order = np.lexsort((ids, hashes))
        begin = exchange.groups(hashes[order])
        firsts = order[begin]
        payload = ids[firsts].view(np.uint64)
        return _questions(key[0].as_py(), buckets, hashes[firsts], payload, 8, 8)

    return ask


def _answer_windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Per chunk, the windows that start in a smaller doc_id of another chunk."""
    asked = [exchange.from_planes(k, 8) for k in table["keys"].to_pylist()]
    own = [exchange.from_planes(p, 8).view(np.int64) for p in table["payload"].to_pylist()]
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    smallest = np.full(len(distinct), LAST)
    np.minimum.at(smallest, place, np.concatenate(own))
    sizes = np.cumsum([len(k) for k in asked])[:-1]
    seen = [k[s < o] for k, s, o in zip(asked, np.split(smallest[place], sizes), own)]
    kept = [i for i, k in enumerate(seen) if len(k)]
    chunks = table["chunk"].to_pylist()
    return _answers(
        [chunks[i] for i in kept], key[0].as_py(), [exchange.to_planes(seen[i], 8) for i in kept], [b""] * len(kept)
    )


def _covered(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``places``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(mask: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text the maximal runs of set words, as (start, length)."""
    spans = []
    for low, high in zip(first[:-1], first[1:]):
        part = np.concatenate(([0], mask[low:high].astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(part))
        spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
    return spans


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,length:int>>, kept_sha256 string"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _remove(window: int, keep_text: bool):
    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        words = find_words(table["text"])
        places, hashes = window_hashes(hash_words(words), words.first, window)
        ids = _ids(table)[words.text_of()[places]]
        distinct, place = np.unique(hashes, return_inverse=True)
        smallest = np.full(len(distinct), LAST)
        np.minimum.at(smallest, place, ids)
        elsewhere = [exchange.from_planes(k, 8) for k in answers["keys"].to_pylist()]
        seen = np.isin(distinct, np.concatenate(elsewhere)) if elsewhere else np.zeros(len(distinct), bool)
        repeated = seen[place] | (smallest[place] < ids)
        gone = _covered(places[repeated], len(words.starts), window)
        kept_texts = []
        for t, (text, low, high) in enumerate(zip(table["text"].to_pylist(), words.first[:-1], words.first[1:])):
            pieces, drop = (text or "").encode().split(), gone[low:high]
            if drop.any():
                pieces = [p for p, d in zip(pieces, drop.tolist()) if not d]
            kept_texts.append(b" ".join(pieces))
        counts = np.concatenate(([0], np.cumsum(gone)))
        columns = {
            "doc_id": table["doc_id"].combine_chunks().cast(pa.int64()),
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_removed": pa.array(counts[words.first[1:]] - counts[words.first[:-1]], pa.int64()),
            "removed": pa.array(_spans(gone, words.first), _SPAN),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts]),
        }
        if keep_text:
            columns["kept_text"] = pa.array([t.decode() for t in kept_texts])
        return pa.table(columns)

    return remove


def removed_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per document: counts, the removed runs of words, the digest of what is left and, if asked, its text."""
    block = (window + 1) // 2
    parts, chunks = exchange.chunked(docs)
    asked = parts.groupBy("chunk").applyInArrow(_ask_anchors(chunks, block), exchange.QUESTION)
    anchors = asked.groupBy("bucket").applyInArrow(_answer_anchors, exchange.ANSWER)
    near = parts.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(
        _ask_windows(chunks, block, window), exchange.QUESTION
    )
    seen = near.groupBy("bucket").applyInArrow(_answer_windows, exchange.ANSWER)
    schema = RESULT + (", kept_text string" if keep_text else "")
    return parts.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(_remove(window, keep_text), schema)
