"""Links between similar sets that share a hash table bucket, without pairing the members of a bucket.

Given the members of buckets, ``links`` returns verified pairs of nodes that connect exactly the nodes which
similar pairs of a bucket connect. Every decision is made on the whole sets.

1. Members are compared with the smallest node of their bucket. Groups of near copies collapse to one root.
2. Buckets whose members still have several roots are searched by lossless prefix filters. A set's elements are
   put in one order for all sets, rare elements first. If two sets are similar enough, the smaller one has a
   common element in its short index prefix and the larger one has it in its probe prefix; where it stands bounds
   what can follow (position filter), sizes must agree (length filter), and so must a few parity words: every element
   turns one of ``PARITY`` bits, so the bits in which two sets differ are no more than the elements in which they do.
   Members that share no more than a common core have rare elements of their own in these prefixes and do not meet,
   or meet and differ in too many bits; only what passes becomes a row.
3. While an element still brings together many members of several roots, these are first compared with their
   smallest node, as in step 1. What is left is paired and verified.

The order comes from a fixed number of counters (``SLOTS``), which tasks fill from all unsettled sets; the links do
not depend on it. Nodes and set elements are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import checked_side, materialized, text_slices, written
from foliolake.llm.simhash_dedup import rooted
from foliolake.llm.words import find_words, hash_words, mix, window_hashes

#: Counters of the element order.
SLOTS = 1 << 20
#: Parity bits of a set, in 64-bit words.
PARITY = 256
_WORDS = [f"parity{k}" for k in range(PARITY // 64)]
#: Pairs per member above which the members of an element are first compared with its smallest node.
CROWD = 8


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of ``width``-word shingles; of a shorter text, that of its whole word sequence."""
    words = find_words(texts, lower=True)
    hashes, counts = hash_words(words), np.diff(words.first)
    text_of = words.text_of()
    values, owners = [], []
    for size in range(1, width + 1):
        places, own = window_hashes(hashes, words.first, size)
        owner = text_of[places]
        whole = counts[owner] >= width if size == width else counts[owner] == size
        values.append(own[whole])
        owners.append(owner[whole])
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return np.split(values, np.searchsorted(owners, np.arange(1, len(counts)))) if len(counts) else []


def node_sets(rows: DataFrame, docs: DataFrame, width: int) -> Callable[[DataFrame], DataFrame]:
    """A function from nodes to their (node, shingles), taken again from one text of each.

    ``rows`` has doc_id, version (the hash of the text) and node; ``docs`` has doc_id, text and version.
    """

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
                yield pa.record_batch([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def of(wanted: DataFrame) -> DataFrame:
        wanted, n = materialized(wanted)
        row = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), "version")
        given = rows.join(checked_side(wanted, n), "node", "leftsemi").groupBy("node").agg(F.min(row).alias("row"))
        given, n = materialized(given.select("node", "row.*"))
        texts = docs.withColumn("missing", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
        texts = texts.join(checked_side(given, n), ["missing", "id", "version"]).select("node", "text")
        # Repeated rows give the same set again.
        return texts.mapInArrow(taken, "node bigint, shingles binary").dropDuplicates(["node"])

    return of


def _similar(percent: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("left_set"), batch.column("right_set")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = 0
                # The smaller set can be no more than the whole intersection.
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("fp").filter(mask), batch.column("root").filter(mask)], names=["fp", "root"])

    return kept


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (fp, root) whose sets have at least ``percent`` of their union in common."""
    both = pairs.join(sets.select(F.col("node").alias("fp"), F.col("shingles").alias("left_set")), "fp")
    both = both.join(sets.select(F.col("node").alias("root"), F.col("shingles").alias("right_set")), "root")
    both = both.select("fp", "root", "left_set", "right_set")
    return written(both.mapInArrow(_similar(percent), "fp bigint, root bigint"), "similar")


def _ordered(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return values[np.lexsort((values, counts[(mix(values) & np.uint64(len(counts) - 1)).astype(np.int64)]))]


def _counted(slots: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for own in batch.column("shingles"):
                values = np.frombuffer(own.as_buffer(), np.uint64)
                np.add.at(total, (mix(values) & np.uint64(slots - 1)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    return counts


def element_counts(sets: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How often the elements of each of ``slots`` hash slots occur: a table of fixed size."""
    counts = sets.select("shingles").mapInArrow(_counted(slots), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()
    total = np.zeros(slots, np.int64)
    total[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    return total


def prefix_lengths(size: int, percent: int) -> tuple[int, int]:
    """(index, probe): elements of a set of ``size`` that must hold one shared with a similar set.

    A set at least as large shares ``2 p / (100 + p)`` of this one, a smaller one ``p / 100`` of it.
    """
    return size - -(-2 * percent * size // (100 + percent)) + 1, size - -(-percent * size // 100) + 1


def parity_words(values: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of elements falls on it, as 64-bit words."""
    odd = np.bincount((mix(values + np.uint64(5)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(counts: np.ndarray, percent: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rows, places, sizes, indexed, parity = [], [], [], [], [], []
            for row, own in enumerate(batch.column("shingles")):
                values = _ordered(np.frombuffer(own.as_buffer(), np.uint64), counts)
                index, probe = prefix_lengths(len(values), percent)
                tokens.append(values[:probe])
                rows.append(np.full(probe, row))
                places.append(np.arange(probe))
                sizes.append(np.full(probe, len(values)))
                indexed.append(np.arange(probe) < index)
                parity.append(parity_words(values))
            if rows:
                words = np.stack(parity).T
                at = pa.array(np.concatenate(rows))
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)), batch.column("node").take(at), batch.column("root").take(at),
                        pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(np.concatenate(indexed)),
                        *[pa.array(np.ascontiguousarray(w)).take(at) for w in words],
                    ],
                    names=["token", "node", "root", "size", "place", "indexed", *_WORDS],
                )

    return entries


def _fits(a: str, b: str, percent: int):
    """Length, position and parity filters of two entries of one element, as a condition."""
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    after = F.least(F.col(f"{a}.size") - F.col(f"{a}.place"), F.col(f"{b}.size") - F.col(f"{b}.place"))
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    differing = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _WORDS), F.lit(0))
    in_common = (100 + percent) * (both - differing) >= 2 * percent * both
    return (100 * small >= percent * large) & ((100 + percent) * after >= percent * both) & in_common


def _rerooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``df`` with the present root of each node in place of an earlier one."""
    names = [c for c in df.columns if c != "root"]
    return df.join(roots.select(F.col("fp").alias("node"), F.col("root").alias("new")), "node", "left").select(
        *names, F.coalesce("new", "node").alias("root")
    )


def _crowded(entries: DataFrame) -> tuple[DataFrame, int, int]:
    """Elements that bring several roots together: (token, low node), their entries, and the pairs they may give."""
    groups = entries.groupBy("token").agg(
        F.min("node").alias("low"), F.count("*").alias("n"), F.count_if("indexed").alias("n_indexed"),
        F.min("root").alias("least"), F.max("root").alias("most"),
    ).filter("least < most AND n_indexed > 0").select("token", "low", "n", "n_indexed")
    groups, _ = materialized(groups)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n_indexed")), F.lit(0))).first()
    return groups.select("token", "low"), total[0], total[1]


def prefix_links(unsettled: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links of step 2 and 3 for ``unsettled`` (node, root), given the links ``known`` so far."""
    own = written(unsettled.join(sets, "node").select("node", "root", "shingles"), "unsettled")
    counts = element_counts(own)
    schema = "token bigint, node bigint, root bigint, size bigint, place bigint, indexed boolean"
    schema += "".join(f", {w} bigint" for w in _WORDS)
    entries = written(own.mapInArrow(_prefixes(counts, percent), schema), "prefixes")
    found = known
    while True:
        groups, n, pairs = _crowded(entries)
        entries = written(entries.join(groups.select("token"), "token", "leftsemi"), "prefixes")
        if pairs <= CROWD * n:
            break
        ends = entries.join(groups, "token")
        lows = entries.alias("b").join(groups.alias("g"), (F.col("b.token") == F.col("g.token")) & (F.col("b.node") == F.col("g.low")))
        lows = lows.select("b.*")
        stars = ends.alias("a").join(lows.alias("b"), F.col("a.token") == F.col("b.token"))
        stars = stars.filter((F.col("a.root") != F.col("b.root")) & _fits("a", "b", percent))
        stars = stars.select(F.greatest("a.node", "b.node").alias("fp"), F.least("a.node", "b.node").alias("root")).distinct()
        stars = stars.join(found.select("fp", "root"), ["fp", "root"], "leftanti")
        new = similar_pairs(stars, sets, percent)
        if not new.limit(1).count():
            break
        found = written(found.unionByName(new), "found")
        entries = written(_rerooted(entries, rooted(found)).select(*entries.columns), "prefixes")
    a, b = entries.filter("indexed").alias("a"), entries.alias("b")
    smaller = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") < F.col("b.node")))
    rest = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & smaller & _fits("a", "b", percent))
    rest = rest.select(F.greatest("a.node", "b.node").alias("fp"), F.least("a.node", "b.node").alias("root")).distinct()
    return found.unionByName(similar_pairs(rest, sets, percent))


def links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(fp, root): verified links that connect exactly what similar pairs of the buckets of ``members`` connect.

    ``members`` (bucket, node) must be cheap to read twice; ``sets_of`` gives the sets of some nodes.
    """
    lows = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    lows, n = materialized(lows.select("bucket", "low"))
    shared = written(members.join(checked_side(lows, n), "bucket"), "shared")
    sets = written(sets_of(shared.select("node").distinct()), "sets")
    stars = shared.filter("node <> low").select(F.col("node").alias("fp"), F.col("low").alias("root")).distinct()
    first = similar_pairs(stars, sets, percent)
    roots, n = materialized(rooted(first))
    placed = shared.select("bucket", "node").join(checked_side(roots.select(F.col("fp").alias("node"), "root"), n), "node", "left")
    placed = written(placed.select("bucket", "node", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    mixed, n = materialized(mixed.select("bucket"))
    unsettled = placed.join(checked_side(mixed, n), "bucket").select("node", "root").distinct()
    return prefix_links(unsettled, sets, first, percent)


def components(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, component_id): the smallest doc_id that links reach, for every node of ``rows`` (doc_id, node)."""
    from foliolake.session import checkpointed

    roots, n = materialized(rooted(linked))
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = distinct.join(checked_side(roots.select(F.col("fp").alias("node"), "root"), n), "node", "left")
    placed = checkpointed(placed.select("node", "first", F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return checkpointed(placed.join(least, "root").select("node", "component_id"))
