"""SimHash near-dedup over vantage-point trees.

A fingerprint is taken from the XXH64 hashes (seed 42) of all three-word shingles: a bit is set where more
than half of them have it. Fingerprints that differ in two bits or fewer are linked; a component is all
documents that links reach.

Only distinct fingerprints are compared. A vantage-point tree, fitted on a bounded sample, parts them by
their Hamming distance to a vantage point: up to the radius inside, beyond it outside. By the triangle
inequality a pair within two bits that a radius parts has its inner member at most two bits within it, so
copying those boundary fingerprints outside puts every pair into one shard at least. Shards that are still
large are parted again by trees of their own. Inside a shard the same pruning goes on in memory down to
small blocks, which are compared exactly. A block gives one link from each member of a local component to
its smallest member, never all pairs; shards are joined by iterated minima with pointer jumping.

The sample (``SAMPLE`` fingerprints a round) only places the vantage points; every fingerprint is indexed
and searched, and the links found do not depend on the tree.

Defined results: null and empty texts have fingerprint zero, which is linked like any other. A null doc_id
gets its fingerprint's component but never names one; the component of null ids alone is null. Repeated
rows are members like others. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import checked_side, materialized, written
from foliolake.session import checkpointed

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints a shard should hold; a shard above it is parted again while that helps.
SHARD = 8192
SAMPLE = 32768
#: Fingerprints compared all with all in memory.
BLOCK = 512
_SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        parts = (words[k:] for k in range(SHINGLE))
        shingles, n = map(b" ".join, zip(*parts)), len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    counts = np.zeros(64, np.int64)
    for low in range(0, n, _SLICE):
        octets = hashes[low : low + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of every row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")


def _distances(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point).astype(np.int64)


def _vantage(prints: np.ndarray, tries: int = 12) -> tuple[np.uint64, int, float] | None:
    """A vantage point and radius that leave the larger side, copies included, as small as may be."""
    best = None
    for point in prints[np.linspace(0, len(prints) - 1, tries).astype(int)]:
        counts = np.cumsum(np.bincount(_distances(prints, point), minlength=65))
        inside = counts[:-1]
        # beyond[r]: all but those at most r - RADIUS away.
        beyond = counts[-1] - np.concatenate(([0] * RADIUS, counts))[: len(inside)]
        size = np.maximum(inside, beyond)
        radius = int(np.argmin(size))
        if best is None or size[radius] < best[2]:
            best = (point, radius, int(size[radius]))
    return None if best is None or best[2] > 0.9 * len(prints) else best


def grow(sample: np.ndarray, leaf: int) -> list[tuple[int, int, int, int]]:
    """Tree nodes (vantage point, radius, inner child, outer child); a child below zero is leaf ``~child``."""
    nodes: list = []
    leaves = 0

    def part(prints: np.ndarray) -> int:
        nonlocal leaves
        found = _vantage(prints) if len(prints) > max(leaf, 8) else None
        if found is None:
            leaves += 1
            return ~(leaves - 1)
        point, radius, _ = found
        place = len(nodes)
        nodes.append(None)
        distance = _distances(prints, point)
        inner = part(prints[distance <= radius])
        outer = part(prints[distance > radius - RADIUS])
        nodes[place] = (int(point), radius, inner, outer)
        return place

    part(sample)
    return nodes


def route(nodes, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index) of every fingerprint in every leaf where a partner within the radius may be."""
    leaves, places = [], []
    waiting = [(0 if nodes else ~0, np.arange(len(prints)))]
    while waiting:
        node, rows = waiting.pop()
        if node < 0:
            leaves.append(np.full(len(rows), ~node))
            places.append(rows)
            continue
        point, radius, inner, outer = nodes[node]
        distance = _distances(prints[rows], np.uint64(point))
        waiting += [(inner, rows[distance <= radius]), (outer, rows[distance > radius - RADIUS])]
    return np.concatenate(leaves), np.concatenate(places)


def _router(trees: dict):
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            for shard in np.unique(shards):
                own = prints[shards == shard]
                leaf, place = route(trees.get(int(shard), (0, []))[1], own.view(np.uint64))
                first = trees.get(int(shard), (int(shard), []))[0]
                yield pa.record_batch([pa.array(leaf + first), pa.array(own[place])], names=["shard", "fp"])

    return routed


def sharded(distinct: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(shard, fp): every two fingerprints within the radius share a shard.

    Rounds go on until no large shard splits any more; a shard is tried once.
    """
    rows = checkpointed(distinct.select(F.lit(0).cast("long").alias("shard"), "fp"))
    free, settled = 1, set()
    while True:
        sizes = rows.groupBy("shard").count().filter((F.col("count") > shard) & ~F.col("shard").isin(sorted(settled)))
        # A round takes as many shards as its sample can part; the others have their turn in the next one.
        large = {r["shard"]: r["count"] for r in sizes.orderBy(F.desc("count")).limit(sample // 16).collect()}
        if not large:
            break
        share = sample / sum(large.values())
        picked = rows.filter(F.col("shard").isin(list(large))) if len(large) < 200 else rows
        # Every large shard gives its fingerprints with the smallest hashes, in proportion to its size.
        bound = 2**63 - 1 if share >= 1 else int(share * 2.0**63)
        picked = picked.filter(F.xxhash64("fp", "shard").bitwiseAND((1 << 63) - 1) <= bound).limit(2 * sample).toPandas()
        trees = {}
        for number, prints in picked.groupby("shard")["fp"]:
            if number not in large:
                continue
            own = prints.to_numpy().view(np.uint64)
            nodes = grow(np.sort(own), max(8, int(len(own) * shard / large[number])))
            settled.add(int(number))
            if nodes:
                trees[int(number)] = (free, nodes)
                free += len(nodes) + 1
        settled |= set(large)
        if not trees:
            continue
        rows = checkpointed(rows.mapInArrow(_router(trees), "shard bigint, fp bigint"))
    return rows


def local_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its local component), for members of components of two or more."""
    members, smallest = [], []
    waiting = [np.unique(prints)]
    while waiting:
        own = waiting.pop()
        found = _vantage(own, 4) if len(own) > BLOCK else None
        if found is not None:
            point, radius, _ = found
            distance = _distances(own, point)
            waiting += [own[distance <= radius], own[distance > radius - RADIUS]]
            continue
        label = _labels(own)
        linked = np.flatnonzero(label != np.arange(len(own)))
        members.append(own[linked])
        smallest.append(own[label[linked]])
    return np.concatenate(members), np.concatenate(smallest)


def _labels(prints: np.ndarray) -> np.ndarray:
    """The smallest index of each component, from comparisons in strips of ``BLOCK``."""
    n = len(prints)
    label = np.arange(n)
    changed = True
    while changed:
        before = label.copy()
        for low in range(0, n, BLOCK):
            near = np.bitwise_count(prints[low : low + BLOCK, None] ^ prints[None, :]) <= RADIUS
            label[low : low + BLOCK] = np.where(near, label[None, :], n).min(axis=1)
        label = label[label]
        changed = not np.array_equal(before, label)
    return label


def _shard_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    prints = table["fp"].combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
    member, smallest = local_links(prints)
    pairs = np.unique(np.stack((member, smallest)), axis=1).view(np.int64)
    return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["fp", "root"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (fp, root) that connect exactly the components of fingerprints."""
    return sharded(distinct).groupBy("shard").applyInArrow(_shard_links, "fp bigint, root bigint").distinct()


def rooted(edges: DataFrame) -> DataFrame:
    """(fp, root) with one root per fingerprint of a component: iterated minima with pointer jumping.

    Every round is written to the shared folder and read back, so plans and lineage stay short. No round has more rows
    than ``edges``; they are counted, and written in as many parts as they need.
    """
    edges = written(edges, "links")
    n = edges.count()
    while True:
        # A fingerprint keeps its least root; its other roots are linked to that one.
        least = edges.groupBy("fp").agg(F.min("root").alias("least"))
        relinked = edges.join(written(least, "least", n), "fp")
        joined = written(
            relinked.select(
                F.when(F.col("root") == F.col("least"), F.col("fp")).otherwise(F.col("root")).alias("fp"),
                F.col("least").alias("root"),
                (F.col("root") > F.col("least")).alias("moved"),
            ).groupBy("fp", "root").agg(F.max("moved").alias("moved")).filter("fp <> root"),
            "joined", n,
        )
        parents = written(joined.groupBy(F.col("fp").alias("root")).agg(F.min("root").alias("parent")), "parents", n)
        jumped = joined.join(parents, "root", "left").select(
            "fp", F.coalesce("parent", "root").alias("root"), (F.col("moved") | F.col("parent").isNotNull()).alias("moved")
        )
        jumped = written(jumped.groupBy("fp", "root").agg(F.max("moved").alias("moved")), "jumped", n)
        edges = jumped.select("fp", "root")
        if not jumped.filter("moved").limit(1).count():
            return edges


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    rows = checkpointed(fingerprints(docs))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots, n_roots = materialized(rooted(links(distinct)))
    placed = distinct.join(checked_side(roots, n_roots), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    placed = checkpointed(placed)
    least = checkpointed(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpointed(placed.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; rows without an id stay."""
    extra = components(docs).filter("component_id < doc_id").select("doc_id").distinct()
    extra, rows = materialized(extra)
    return docs.join(checked_side(extra, rows), "doc_id", "leftanti").select(docs.columns)
