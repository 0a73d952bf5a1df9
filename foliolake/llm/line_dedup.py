"""Line dedup by winnowing.

The lines of a document that hold a word are its sequence; a run of three or more of them is repeated when
the same lines, in the same order, stand earlier: in a document with a smaller doc_id, or further up in the
same one. All lines of the later run are deleted. With ``words``, a run of one or two lines is repeated too if
it has at least so many words; the pipeline asks for that, op9 (which SQL states) does not.

Method. Every window of three consecutive lines selects its smallest line hash, the last one among equals.
Equal windows select the same line, so the selected lines are fingerprints that no repeated run can avoid.
Fingerprints that occur more than once are joined with their places; from each the match is extended both
ways through the windows that selected it, and a window with an earlier place is deleted. Neighbouring
windows join into maximal runs. Windows of one or two lines with words enough are fingerprints themselves.

A hash that a third of all documents share is counted before it is shuffled and joined by a checked
broadcast or a join whose partitions Spark can split; places are compared with the earliest one, never with
each other. Lines are compared by 64-bit hashes.

Defined results: null and empty texts, and lines without a word, have nothing to repeat; such lines stay. A
null doc_id comes after all numbers. Rows that share a doc_id, or have none, are judged each by its own text
and follow each other by a hash of it; equal rows do not repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import checked_side, free_prefix, materialized, whole_text
from foliolake.llm.words import window_hashes
from foliolake.session import checkpointed

RUN = 3
#: Words that make a run of fewer lines count, where it is asked for.
LONG = 50
#: What tells rows apart, in the order of documents: null ids come last.
KEY = ("missing", "id", "version")


def sequence(text: str | None) -> tuple[list[bytes], list[int]]:
    """All lines of a text, and the places of those that hold a word."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip()]


def _line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the number of words of every line with a word."""
    lines, places = sequence(text)
    hashes = np.fromiter((xxhash.xxh64_intdigest(lines[i]) for i in places), np.uint64, len(places))
    return hashes, np.fromiter((len(lines[i].split()) for i in places), np.int64, len(places))


def long_windows(hashes: np.ndarray, counts: np.ndarray, width: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``width`` lines that have ``words`` words or more."""
    starts, own = window_hashes(hashes, np.array([0, len(hashes)]), width)
    total = np.concatenate(([0], np.cumsum(counts)))
    enough = total[starts + width] - total[starts] >= words
    return starts[enough], own[enough]


def winnow(hashes: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``run`` hashes, the place of its minimum (the last of equals) and its own hash."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    selected = np.arange(n) + run - 1 - np.argmin(windows[:, ::-1], axis=1)
    return selected, window_hashes(hashes, np.array([0, len(hashes)]), run)[1]


def _select(run: int, words: int | None):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints, begins, windows, widths, offsets, n = [], [], [], [], [], [0], 0
            for row, text in enumerate(batch.column("text")):
                hashes, counts = _line_hashes(text.as_py())
                selected, own = winnow(hashes, run)
                # Selected places never fall, so the windows of one place are neighbours.
                places, begin = np.unique(selected, return_index=True)
                rows += [row] * len(places)
                prints.append(hashes[places])
                begins.append(np.arange(len(own)))
                windows.append(own)
                widths += [run] * len(places)
                offsets += [n + int(e) for e in (*begin[1:], len(own))] if len(own) else []
                n += len(own)
                for width in range(1, run) if words is not None else ():
                    starts, own = long_windows(hashes, counts, width, words)
                    rows += [row] * len(own)
                    prints.append(own)
                    begins.append(starts)
                    windows.append(own)
                    widths += [width] * len(own)
                    offsets += range(n + 1, n + len(own) + 1)
                    n += len(own)
            flat = np.concatenate([*windows, np.zeros(0, np.uint64)]).view(np.int64)
            starts = np.concatenate([*begins, np.zeros(0, int)]).astype(np.int32)
            bounds = pa.array(offsets, pa.int32())
            yield pa.record_batch(
                [*(batch.column(name).take(pa.array(rows, pa.int32())) for name in KEY),
                 pa.array(np.concatenate([*prints, np.zeros(0, np.uint64)]).view(np.int64)),
                 pa.array(widths, pa.int32()),
                 pa.ListArray.from_arrays(bounds, pa.array(starts)), pa.ListArray.from_arrays(bounds, pa.array(flat))],
                names=[*KEY, "fingerprint", "width", "starts", "windows"],
            )

    return select


def _row_key() -> list:
    """The columns of ``KEY``."""
    doc_id = F.col("doc_id").cast("long")
    values = doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64("text")
    return [value.alias(name) for value, name in zip(values, KEY)]


def repeated_windows(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """``KEY`` and the (start, width), counted in lines with a word, of windows that stand earlier elsewhere."""
    selected = checkpointed(
        docs.select(*_row_key(), "text").mapInArrow(
            _select(run, words),
            "missing boolean, id bigint, version bigint, fingerprint bigint, width int, starts array<int>, windows array<bigint>"
        )
    )
    shared, n = materialized(selected.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    matched = selected.join(checked_side(shared, n), "fingerprint", "leftsemi")
    places = checkpointed(
        matched.select(*KEY, "width", F.explode(F.arrays_zip("starts", "windows")).alias("w"))
        .select(*KEY, "width", F.col("w.starts").alias("start"), F.col("w.windows").alias("window"))
    )
    place = F.struct(*KEY, "start")
    earliest = places.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    earliest, n = materialized(earliest.select("window", "first"))
    later = places.join(checked_side(earliest, n), "window").filter(place > F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_set(F.struct("start", "width")).alias("starts"))


def _cut(text: str | None, starts: list[dict] | None) -> tuple[str | None, int, int, list[dict]]:
    """Text without its repeated runs, lines with a word, deleted ones, and the runs as (first line, lines)."""
    lines, places = sequence(text)
    if not starts:
        return text, len(places), 0, []
    gone = np.zeros(len(places), bool)
    for window in starts:
        gone[window["start"] : window["start"] + window["width"]] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    runs = [{"line": places[a], "lines": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
    drop = {places[i] for i in np.flatnonzero(gone)}
    left = b"\n".join(line for i, line in enumerate(lines) if i not in drop)
    return left.decode("utf-8", "surrogatepass"), len(places), int(gone.sum()), runs


_ADDED = (("n_lines", "bigint"), ("n_removed", "bigint"), ("removed", "array<struct<line:int,lines:int>>"))
_RUNS = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32())]))


def _cutter(prefix: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _cut(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column(f"{prefix}starts"))
            ]
            texts, lines, removed, runs = zip(*rows) if rows else ((), (), (), ())
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, "text", pa.array(texts, pa.string()))
            batch = batch.drop_columns([f"{prefix}starts"])
            columns = [*batch.columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, _RUNS)]
            yield pa.record_batch(columns, names=[*batch.schema.names, *(prefix + name for name, _ in _ADDED)])

    return cut


def cut_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> tuple[DataFrame, str]:
    """``docs`` with ``text`` cut and three columns more: n_lines, n_removed, removed (first line, lines).

    The names of the three begin with the prefix that is returned, which no column of ``docs`` has.
    """
    prefix = free_prefix(docs)
    # The join is never a broadcast of ours: a third of all documents may have a repeated run.
    spans = checkpointed(repeated_windows(docs, run, words)).select(
        *(F.col(name).alias(prefix + name) for name in KEY), F.col("starts").alias(f"{prefix}starts")
    )
    keys = [F.col(prefix + name) for name in KEY]
    same = [own == key for own, key in zip(_row_key(), keys)]
    joined = docs.join(spans, same, "left").drop(*(prefix + name for name in KEY))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    schema += [f"`{prefix}{name}` {kind}" for name, kind in _ADDED]
    return joined.mapInArrow(_cutter(prefix), ", ".join(schema)), prefix


def deduplicated(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """The documents without their repeated runs; those of which no line with a word is left go.

    ``n_chars``, where the table has it, follows the text.
    """
    cut, prefix = cut_lines(docs, run, words)
    removed, lines = F.col(f"{prefix}n_removed"), F.col(f"{prefix}n_lines")
    cut = cut.filter((removed == 0) | (removed < lines))
    if "n_chars" in docs.columns:
        length = F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cut.select([F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_lines, n_removed, removed, kept_text of every document."""
    cut, prefix = cut_lines(docs.select("doc_id", "text"), run)
    return cut.select(
        "doc_id", *(F.col(prefix + name).alias(name) for name, _ in _ADDED), whole_text().alias("kept_text")
    )
