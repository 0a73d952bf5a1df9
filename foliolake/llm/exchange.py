"""Questions that every part of a corpus asks about keys which all parts share.

Texts are dealt into chunks of a few megabytes by a hash of their row. A chunk asks about its distinct
keys, so a key that fills a third of the corpus costs one entry per chunk; the keys are sent sorted, in
packed byte planes, to the bucket of their value. A bucket answers each chunk, and the chunk, which is
read again from the same shuffle files, applies the answers. No row is dropped on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, which one task holds with about thirty bytes per word.
CHUNK_BYTES = 6 << 20

QUESTION = "bucket int, chunk int, keys binary, payload binary"
ANSWER = "chunk int, bucket int, keys binary, payload binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, kind=None) -> tuple[DataFrame, int]:
    """doc_id, text, chunk of all rows, and the number of chunks, which grows with the text.

    ``kind`` (an expression of 0 or 1) keeps two kinds of rows in chunks of their own: even and odd ones.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + total // chunk_bytes
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    if kind is not None:
        dealt = dealt * 2 + kind
    return docs.select("doc_id", "text", dealt.alias("chunk")), chunks


def to_planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of ``width`` bytes, one byte plane after another, which compress well; larger ones are refused."""
    if width < 8 and len(values) and int(values.max()) >> (8 * width):
        raise OverflowError(f"a value needs more than {width} bytes")
    parts = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return parts.T[::-1].tobytes()


def from_planes(data: bytes | pa.Buffer, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)[::-1].T
    whole = np.zeros((planes.shape[0], 8), np.uint8)
    whole[:, :width] = planes
    return whole.view("<u8").reshape(-1).astype(np.uint64, copy=False)


def bucket_ranges(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, low, high) of the buckets that occur in sorted 64-bit keys."""
    number = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(number)) + 1
    lows = np.concatenate(([0], edges)) if len(keys) else np.zeros(0, int)
    for low, high in zip(lows, np.append(edges, len(keys))):
        yield int(number[low]), int(low), int(high)


def groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in sorted keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
