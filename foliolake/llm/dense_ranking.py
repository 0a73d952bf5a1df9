"""Ranked lexical search by dense blocked matrix products.

Every item is scored against every document: the score sums, over the item's distinct terms, the term's weight
times a whole-number impact that grows with its occurrences and falls with the document's length. Terms are
maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.

Method. The items' terms form a compact vocabulary. One pass over the texts keeps, per document, its length and
the occurrences of vocabulary terms; document frequencies, their number and total length are summed from that
table. Scoring multiplies an item tile (0 or 1 per item and term) by a document tile (term impacts) in float64
BLAS. Impacts are whole numbers below ``weight * 10**6``, and a vocabulary tile has so few terms that no partial
sum reaches 2**53, so every product is exact; tiles are added as 64-bit integers. A task keeps the best ``k``
documents of each item over all its tiles, with scores equal to the last kept one compared by id, so ties never
depend on tiles or tasks. The tasks' lists are ranked in two steps.

Items are taken in blocks of at most ``PAIRS`` (item, term) pairs in the mean, which bounds what is sent to tasks;
each block is one pass over the documents. Terms are told apart by 64-bit hashes.

Defined results: null and empty texts have no term, count for nothing and are never ranked; items without a known
term have no row. Rows without doc_id count and are ranked, after equal scores with one. Repeated documents are
ranked each; repeated rows (item_id, text) are one item, different texts under one item_id are ranked apart. An
empty table of either kind gives no rows. Texts are worked on in slices of bytes, one long text at least; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.llm.common import text_slices, written
from foliolake.llm.words import find_words, hash_words

TOP = 10
#: (item, term) pairs of a block of items.
PAIRS = 1 << 19
#: Sides of the tiles: items, terms, documents.
ITEMS = 256
TERMS = 1024
DOCS = 512
_EXACT = 1 << 53

# Fixed values of the score.
_SCALE = 1000
_GAIN = 1_000_000_000
_LENGTH_SHARE = 90
_LENGTH_FACTOR = 8

_IS_TERM = np.zeros(256, bool)
_IS_TERM[48:58] = _IS_TERM[65:91] = _IS_TERM[97:123] = True
_IS_TERM[128:] = True


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = find_words(batch.column("text"), lower=True, is_word=_IS_TERM)
        parts = np.split(hash_words(words), words.first[1:-1]) if batch.num_rows else []
        terms = [np.unique(own).view(np.int64) for own in parts]
        yield pa.record_batch(
            [batch.column("item_id").cast(pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"]
        )


def _postings(vocabulary: np.ndarray):
    """Per document its number of terms and, for terms of the sorted vocabulary, places and occurrences."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = find_words(part.column("text"), lower=True, is_word=_IS_TERM)
                hashes, rows = hash_words(words), part.num_rows
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[place] == hashes
                keys, counts = np.unique(words.text_of()[hit] * len(vocabulary) + place[hit], return_counts=True)
                bounds = np.searchsorted(keys, np.arange(rows + 1) * len(vocabulary)).astype(np.int32)
                terms = pa.array((keys % len(vocabulary)).astype(np.int32))
                yield pa.record_batch(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array(np.diff(words.first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds), terms),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return found


def _frequencies(size: int):
    """Documents of this task that hold each vocabulary term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return counted


def weights(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """The whole-number weight of terms by their document frequency."""
    return np.array(
        [math.floor(_SCALE * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64
    )


def length_part(lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The length term of the impact's denominator, in whole numbers."""
    if _LENGTH_SHARE * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 100 - _LENGTH_SHARE + _LENGTH_SHARE * lengths * n_docs // total
    return np.array([100 - _LENGTH_SHARE + _LENGTH_SHARE * int(n) * n_docs // total for n in lengths], np.int64)


def tile_terms(weight: int) -> int:
    """How many terms of at most this weight a product may add and stay exact."""
    return max(1, min(TERMS, (_EXACT - 1) // max(1, weight * (_GAIN // _SCALE))))


class ItemTiles:
    """Items in tiles; each tile has its own vocabulary, cut into pieces that add up exactly."""

    def __init__(self, pairs: list[np.ndarray], weight: np.ndarray):
        self.tiles = []
        piece = tile_terms(int(weight.max(initial=1)))
        for low in range(0, len(pairs), ITEMS):
            own = pairs[low : low + ITEMS]
            terms = np.unique(np.concatenate(own))
            held = np.zeros((len(own), len(terms)))
            for k, places in enumerate(own):
                held[k, np.searchsorted(terms, places)] = 1.0
            cuts = range(0, len(terms), piece)
            self.tiles.append((low, len(own), [(terms[c : c + piece], held[:, c : c + piece]) for c in cuts]))

    def scores(self, tile: int, places: np.ndarray, rows: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """Scores (items, documents) of one tile, from impacts of (term, document) places."""
        _, items, pieces = self.tiles[tile]
        total = np.zeros((items, n), np.int64)
        for terms, held in pieces:
            at = np.minimum(np.searchsorted(terms, places), len(terms) - 1)
            hit = terms[at] == places
            if hit.any():
                seen, local = np.unique(at[hit], return_inverse=True)  # only terms that the documents hold
                dense = np.zeros((len(seen), n))
                dense[local, rows[hit]] = impact[hit]
                total += (held[:, seen] @ dense).astype(np.int64)
        return total


class Best:
    """The best ``k`` documents of every item so far: higher score first, then smaller id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # a score of zero is never kept
        self.rows = np.zeros(0, [("item", "i8"), ("score", "i8"), ("none", "?"), ("id", "i8")])

    def add(self, low: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[low : low + len(scores), None])
        if not len(item):
            return
        new = np.empty(len(item), self.rows.dtype)
        new["item"], new["score"], new["none"], new["id"] = item + low, scores[item, doc], none[doc], ids[doc]
        rows = np.concatenate((self.rows, new))
        rows = rows[np.lexsort((rows["id"], rows["none"], -rows["score"], rows["item"]))]
        place = np.arange(len(rows)) - np.searchsorted(rows["item"], rows["item"])
        self.rows = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.least[last["item"]] = last["score"]


def _ranker(item_ids: list, pairs: list[np.ndarray], frequencies: np.ndarray, n_docs: int, total: int, k: int):
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights(frequencies, n_docs)
        tiles, best = ItemTiles(pairs, weight), Best(len(pairs), k)
        for batch in batches:
            for low in range(0, batch.num_rows, DOCS):
                part = batch.slice(low, DOCS)
                own = part.column("terms")
                sizes = np.diff(own.offsets.to_numpy())
                rows = np.repeat(np.arange(part.num_rows), sizes)
                places = own.flatten().to_numpy()
                times = part.column("counts").flatten().to_numpy().astype(np.int64)
                length = length_part(part.column("n").to_numpy(), n_docs, total)[rows]
                impact = (weight[places] * (_GAIN * times // (_SCALE * times + _LENGTH_FACTOR * length))).astype(np.float64)
                ids = part.column("doc_id")
                none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                for tile, (first, _, _) in enumerate(tiles.tiles):
                    best.add(first, tiles.scores(tile, places, rows, impact, part.num_rows), ids, none)
        rows = best.rows
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield pa.record_batch(
            [
                pa.array(np.ascontiguousarray(rows["item"])), pa.array([item_ids[k] for k in rows["item"]], pa.int64()),
                pa.array(np.full(len(rows), part, np.int64)), pa.array(np.ascontiguousarray(rows["id"]), mask=rows["none"].copy()),
                pa.array(np.ascontiguousarray(rows["score"])),
            ],
            names=["item", "item_id", "part", "doc_id", "score"],
        )

    return ranked


def _block_ranks(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    pairs = [np.array(r["terms"], np.int64).view(np.uint64) for r in items]
    vocabulary = np.unique(np.concatenate(pairs))
    postings = written(
        docs.mapInArrow(_postings(vocabulary), "doc_id bigint, n bigint, terms array<int>, counts array<int>").filter("n > 0"),
        "postings",
    )
    n_docs, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    counted = postings.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term bigint, df bigint")
    counted = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # no more rows than the block has terms
    frequencies = np.zeros(len(vocabulary), np.int64)
    frequencies[counted["term"].to_numpy()] = counted["df"].to_numpy()
    places = [np.searchsorted(vocabulary, own) for own in pairs]
    ranker = _ranker([r["item_id"] for r in items], places, frequencies, n_docs, total, k)
    lists = postings.filter(F.size("terms") > 0).mapInArrow(
        ranker, "item bigint, item_id bigint, part bigint, doc_id bigint, score bigint"
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", F.col("part") % 64], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        lists = lists.withColumn("rank", place).filter(F.col("rank") <= k)
    return lists.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    docs = docs.select("doc_id", "text")
    sets = items.select("item_id", "text").distinct().mapInArrow(_item_terms, "item_id bigint, terms array<bigint>")
    sets = written(sets.filter(F.size("terms") > 0), "item_terms")
    n = sets.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(n / pairs))
    found = []
    for block in range(blocks):
        own = sets.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()
        part = _block_ranks(docs, sorted(own, key=lambda r: (r["item_id"] is None, r["item_id"] or 0)), k) if own else None
        found += [] if part is None else [part]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)
