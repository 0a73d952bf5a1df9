"""Near-duplicate documents by the Jaccard similarity of their five-word shingles.

Words are parted by white space, A-Z lower-cased; a text of one to four words has its word sequence as its
only shingle. Two documents are linked when their sets of distinct shingles have a Jaccard similarity of 0.8
or more; a component is all documents that links reach.

Method. Equal sets are one node. Buckets of nodes come from two searches. The first is that of ``simhash_dedup``: nodes
have SimHash fingerprints, vantage-point shards find all that differ in two bits or fewer, and a component of
fingerprints is a bucket. By calculation pairs near 0.8 differ in some eight of 64 bits, a radius at which vantage points
part hardly anything, so the second search takes what is farther apart: each node has 100 MinHash values in 25 bands of four, and
nodes that agree in a band share a bucket. A pair of similarity 0.8 shares none with a chance of 2 in a million, which
is the only loss. ``table_links`` links the members of a bucket on their whole sets: first with its smallest node, then,
where several roots are left, through lossless prefix filters, so members that only share a common core never meet.

Defined results: null and empty texts have the empty set, which is one node. Rows without an id are linked
like others but never dropped, and never cause a drop. Rows that share an id are judged each by its text.
Long texts are worked on whole, one at least at a time; an empty table stays empty. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm import simhash_dedup, table_links
from foliolake.llm.common import checked_side, free_prefix, materialized, text_slices, written
from foliolake.llm.words import mix

SHINGLE = 5
PERCENT = 80
BANDS = 25
ROWS = 4
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_MASK = mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64))


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` hashes per nonempty set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]], dtype=np.int64)))
    values = np.concatenate(sets)
    least = np.stack([np.minimum.reduceat((values ^ m) * a, starts) for m, a in zip(_MASK, _ODD)], axis=1)
    least = mix(least).reshape(len(sets), BANDS, ROWS)
    out = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))[None, :].repeat(len(sets), axis=0)
    for k in range(ROWS):
        out = mix(out + least[:, :, k])
    return out


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            sets = table_links.shingle_sets(part.column("text"), SHINGLE)
            nodes = np.fromiter(map(_node, sets), np.uint64, len(sets)).view(np.int64)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands = [None] * len(sets)
            if full:
                for k, own in zip(full, band_hashes([sets[k] for k in full]).view(np.int64)):
                    bands[k] = own
            prints = np.array([simhash_dedup.fingerprint(t.as_py()) for t in part.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch(
                [part.column("doc_id"), part.column("version"), pa.array(nodes), pa.array(prints), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "version", "node", "fp", "bands"],
            )


def fingerprint_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, node): the nodes of each component of fingerprints within two bits."""
    # Equal sets whose shingles repeat differently are one node with several fingerprints.
    prints = written(rows.filter("bands IS NOT NULL").select("node", "fp").distinct(), "prints")
    roots, n = materialized(simhash_dedup.rooted(simhash_dedup.links(prints.select("fp").distinct())))
    placed = prints.join(checked_side(roots, n), "fp", "left")
    return placed.select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("bucket"), "node")


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, root): the larger and the smaller node of links that connect exactly the components."""
    nodes = rows.groupBy("node").agg(F.first("bands").alias("bands"))
    members = nodes.select(F.explode("bands").alias("bucket"), "node").unionByName(fingerprint_buckets(rows))
    members = written(members, "members")
    return table_links.links(members, table_links.node_sets(rows, docs, SHINGLE), PERCENT)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text) and component_id (the smallest doc_id that links reach) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"))
    rows = written(docs.mapInArrow(_sketches, "doc_id bigint, version bigint, node bigint, fp bigint, bands array<bigint>"), "sketches")
    named = table_links.components(rows, links(rows, docs))
    return rows.select("doc_id", "version", "node").join(named, "node").select("doc_id", "version", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; rows without an id stay."""
    prefix = free_prefix(docs)
    extra = components(docs).filter("component_id < doc_id").select(
        F.col("doc_id").alias(f"{prefix}id"), F.col("version").alias(f"{prefix}version")
    )
    extra, n = materialized(extra.distinct())
    same = (F.col("doc_id").cast("long") == F.col(f"{prefix}id")) & (F.xxhash64("text") == F.col(f"{prefix}version"))
    return docs.join(checked_side(extra, n), same, "leftanti").select([F.col(f"`{c}`") for c in docs.columns])
