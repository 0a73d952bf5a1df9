"""MinHash near-duplicates by tensored banding.

A document's set holds its distinct three-word shingles (white-space words, A-Z lower-cased; a shorter text has its
word sequence as its one shingle). Documents are linked when at least ``PERCENT`` of the union of their sets is
common; a component is all documents that links reach.

Method. Two small collections, left and right, hold ``HALVES`` hashes each, every one of ``DEPTH`` MinHash values.
A table key pairs a left with a right hash, so ``HALVES ** 2`` tables of ``2 * DEPTH`` values each are keyed by only
``2 * HALVES * DEPTH`` MinHash values, about the square root of the work of independent tables. Similar documents
meet unless all left or all right hashes differ: at 85 % a chance of 4 in ten million. Halves that nobody shares are
dropped before they are paired. What shares a key is verified on the full sets by ``table_links``, which links
members of a table bucket without pairing them all.

Defined results: null and empty texts have the empty set, are linked with nothing and are their own component.
Equal sets are one node, so exact copies cost nothing. Rows with a null doc_id are linked like others but never name
a component; a component of nothing else is null, and ``kept`` compares null-safe. Repeated rows are members like
others. Long texts are worked on whole, one at least at a time. An empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm import table_links
from foliolake.llm.common import text_slices, written
from foliolake.llm.words import mix

SHINGLE = 3
PERCENT = 85
HALVES = 12
DEPTH = 2
_VALUES = 2 * HALVES * DEPTH
_ODD = mix(np.arange(2001, 2001 + _VALUES, dtype=np.uint64)) | np.uint64(1)
_MASK = mix(np.arange(3001, 3001 + _VALUES, dtype=np.uint64))


def half_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``2 * HALVES`` hashes per nonempty set: those of the left collection, then the right ones."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]], dtype=np.int64)))
    values = np.concatenate(sets)
    least = np.stack([np.minimum.reduceat((values ^ m) * a, starts) for m, a in zip(_MASK, _ODD)], axis=1)
    least = mix(least).reshape(len(sets), 2 * HALVES, DEPTH)
    out = mix(np.arange(2 * HALVES, dtype=np.uint64) + np.uint64(91))[None, :].repeat(len(sets), axis=0)
    for k in range(DEPTH):
        out = mix(out + least[:, :, k])
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            sets = table_links.shingle_sets(part.column("text"), SHINGLE)
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            full = [k for k, s in enumerate(sets) if len(s)]
            halves = [None] * len(sets)
            if full:
                for k, own in zip(full, half_hashes([sets[k] for k in full]).view(np.int64)):
                    halves[k] = own
            yield pa.record_batch(
                [
                    part.column("doc_id"), part.column("version"), pa.array(nodes),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(halves, pa.list_(pa.int64())),
                ],
                names=["doc_id", "version", "node", "n_shingles", "halves"],
            )


def table_keys(nodes: DataFrame) -> DataFrame:
    """(bucket, node): the table keys of nodes, without those of a half that no other node has."""
    single = nodes.select("node", F.posexplode("halves").alias("place", "half"))
    common = single.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    halves = single.join(common, "half").groupBy("node").agg(
        F.collect_list(F.when(F.col("place") < HALVES, F.col("half"))).alias("left"),
        F.collect_list(F.when(F.col("place") >= HALVES, F.col("half"))).alias("right"),
    )
    pairs = halves.select("node", F.explode("left").alias("left"), "right").select("node", "left", F.explode("right").alias("right"))
    return pairs.select(F.xxhash64("left", "right").alias("bucket"), "node")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"))
    schema = "doc_id bigint, version bigint, node bigint, n_shingles bigint, halves array<bigint>"
    rows = written(docs.mapInArrow(_sketches, schema), "sketches")
    full = rows.filter("n_shingles > 0")
    nodes = written(full.groupBy("node").agg(F.first("halves").alias("halves")), "nodes")
    members = written(table_keys(nodes), "tables")
    linked = table_links.links(members, table_links.node_sets(full, docs, SHINGLE), PERCENT)
    named = table_links.components(full, linked)
    placed = rows.join(named.withColumnRenamed("node", "named"), (F.col("node") == F.col("named")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id) of one document of each component, that with the smallest id, and of rows without words."""
    return components(docs).filter("kept").select("doc_id")
