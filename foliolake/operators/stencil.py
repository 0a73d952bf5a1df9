"""Neighbourhood kernels over bands of scanlines.

A page is cut into bands of ``BAND_ROWS`` rows. Each scanline is sent to its own band and to the
neighbours that need it as halo, so a task holds at most ``BAND_ROWS + 2 * radius`` rows of one page
however long the page is. Spark does the partitioning; a short NumPy function does the arithmetic of
one band as if it were a whole page, and only the rows owned by the band are kept. Rows at a cut are
wrong by construction for at most ``radius`` rows and are never kept; rows at a true page edge get
the kernel's own border rule.

A page may lack scanlines. Its bands also get the ``radius`` lines that come next on either side, however far,
and the planes of a kernel hold the lines that are there, in order, so a neighbour is the next line present.
Weighted means go by place: there a missing line counts as zero (``Lines``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolake.operators.raster import PAGE, attach_page_values, byte_line
from foliolake.session import checkpointed

BAND_ROWS = 128
#: Rows whose results a task holds at once, where a group has no more: what comes out of a row can be many times as large.
PORTION_ROWS = 1024
Planes = Mapping[str, np.ndarray]
#: Among the planes: where the lines of a band lie, or None for a page without gaps.
LINES = "_lines"


@dataclass(frozen=True)
class Lines:
    """Places of the lines of a band whose page lacks some, and the page's last place."""

    y: np.ndarray
    last: int


def plane_of(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long rows as one 2-D array."""
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype == np.int8:  # a byte line
        flat = flat.astype(np.int32) + 128
    return flat.reshape(len(rows), -1)


def list_of(plane: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    offsets = np.arange(plane.shape[0] + 1, dtype=np.int32) * plane.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(plane).ravel(), type=type_))


def band_rows(scan: DataFrame, radius: int, rows: int = BAND_ROWS) -> DataFrame:
    """Scanlines copied to every band that reads them."""
    first = F.greatest(F.floor((F.col("y") - radius) / rows), F.lit(0))
    last = F.floor((F.col("y") + radius) / rows)
    return scan.withColumn("band", F.explode(F.sequence(first.cast("int"), last.cast("int"))))


def gapped_pages(scan: DataFrame, keys: Sequence[str] = (PAGE,)) -> DataFrame | None:
    """Pages that lack lines, with their last line ``_last``; None if every page is whole, as is usual."""
    pages = scan.groupBy(*keys).agg(F.max("y").cast("int").alias("_last"), F.count("y").alias("_n"))
    gapped = checkpointed(pages.where("_n <> _last + 1").select(*keys, "_last"))
    return None if gapped.isEmpty() else gapped


def _gapped_band_rows(scan: DataFrame, radius: int, rows: int, keys: Sequence[str], gapped: DataFrame) -> DataFrame:
    """``band_rows`` where lines of ``gapped`` pages also go to the bands of the ``radius`` lines next to them.

    Only line numbers of gapped pages are sorted by page; the window looks at ``2 * radius + 1`` of them at a time.
    """
    near = Window.partitionBy(*keys).orderBy("y").rowsBetween(-radius, radius)
    numbers = scan.select(*keys, "y").join(gapped.select(*keys), list(keys), "left_semi").distinct()
    reach = numbers.select(*keys, "y", F.collect_set(F.floor(F.col("y") / rows).cast("int")).over(near).alias("_reach"))
    first = F.greatest(F.floor((F.col("y") - radius) / rows), F.lit(0)).cast("int")
    last = F.floor((F.col("y") + radius) / rows).cast("int")
    bands = F.array_union(F.sequence(first, last), F.coalesce("_reach", F.array().cast("array<int>")))
    marked = attach_page_values(scan, gapped, keys, how="left").join(reach, [*keys, "y"], "left")
    return marked.withColumn("band", F.explode(bands)).drop("_reach")


def _banded(scan: DataFrame, radius: int, rows: int, keys: Sequence[str], whole: bool) -> DataFrame:
    gapped = None if whole else gapped_pages(scan, keys)
    return band_rows(scan, radius, rows) if gapped is None else _gapped_band_rows(scan, radius, rows, keys, gapped)


def _planes(table: pa.Table, names: Sequence[str]) -> dict:
    lines = None
    if "_last" in table.column_names and table.column("_last")[0].is_valid:
        lines = Lines(table.column("y").to_numpy(), table.column("_last")[0].as_py())
    return {**{n: plane_of(table.column(n)) for n in names}, LINES: lines}


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows, but the first, whose keys are not those of the row before."""
    changed = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for k in keys:
        column = table.column(k)
        after, before = column.slice(1), column.slice(0, len(column) - 1)
        one_null = pc.xor(after.is_null(), before.is_null())  # two nulls are the same group
        changed |= pc.fill_null(pc.not_equal(after, before), False).to_numpy() | one_null.to_numpy()
    return np.flatnonzero(changed) + 1


def group_tables(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[pa.Table]]:
    """Complete groups of a partition sorted by ``keys``, a list per Arrow batch; holds one open group.

    Groups are slices of their batch; only one that goes on in the next batch is copied.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cuts = [0, *_changes(table, keys).tolist(), table.num_rows]
        groups = [table.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:])]
        if held is not None:
            if len(_changes(pa.concat_tables([held.slice(held.num_rows - 1), table.slice(0, 1)]), keys)):
                groups.insert(0, held)
            else:
                groups[0] = pa.concat_tables([held, groups[0]]).combine_chunks()
        held = groups.pop()
        yield groups
    if held is not None:
        yield [held]


def portions(groups: Sequence[pa.Table], rows: int = PORTION_ROWS) -> Iterator[list[pa.Table]]:
    """Runs of groups of up to ``rows`` rows in all, one group at least."""
    held, n = [], 0
    for group in groups:
        if held and n + group.num_rows > rows:
            yield held
            held, n = [], 0
        held.append(group)
        n += group.num_rows
    if held:
        yield held


def map_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[list[pa.Table]], list[pa.Table]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run ``fn`` on lists of whole groups, each sorted by ``order``.

    Groups are clustered by hash and streamed many to an Arrow batch, so small groups cost no round
    trip of their own; results leave in portions, so a full batch does not have all of its results in memory. A group must be bounded by construction (a band, a tile), never a whole page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in group_tables(batches, keys):
            for portion in portions(groups):
                made = [t for t in fn(portion) if t is not None and t.num_rows]
                if made:
                    yield from pa.concat_tables(made).combine_chunks().to_batches()

    clustered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return clustered.mapInArrow(run, schema)


def _travelling(names: Sequence[str], levels: Sequence[str]) -> list:
    return [byte_line(F.col(n)).alias(n) if n in levels else F.col(n) for n in names]


def _owned(table: pa.Table, rows: int) -> slice | None:
    band = table.column("band")[0].as_py()
    lo, hi = np.searchsorted(table.column("y").to_numpy(), [band * rows, (band + 1) * rows])
    return None if lo == hi else slice(int(lo), int(hi))


def map_bands(
    scan: DataFrame,
    kernel: Callable[[Planes], Planes],
    radius: int,
    inputs: Sequence[str],
    outputs: Mapping[str, str],
    keys: Sequence[str] = (PAGE,),
    carry: Sequence[str] = (),
    rows: int = BAND_ROWS,
    levels: Sequence[str] = (),
    whole: bool = False,
) -> DataFrame:
    """Apply ``kernel`` (planes in, planes out) and return scanlines.

    ``outputs`` gives each produced column's element type (``int`` or ``double``); ``carry`` lists
    page-wide scalar columns passed through; ``levels`` names inputs of 0..255, which travel as bytes.
    ``whole`` states that no page lacks lines, which is looked up otherwise.
    """
    element = {"int": (T.IntegerType(), pa.int32()), "double": (T.DoubleType(), pa.float64())}
    passed, names = [*keys, "y", *carry], list(inputs)
    source = _banded(scan.select(*passed, *_travelling(names, levels)), radius, rows, keys, whole)
    schema = T.StructType(
        [source.schema[c] for c in passed]
        + [T.StructField(n, T.ArrayType(element[t][0])) for n, t in outputs.items()]
    )

    def one_band(table: pa.Table) -> pa.Table | None:
        core = _owned(table, rows)
        if core is None:
            return None
        result = kernel(_planes(table, names))
        kept = table.slice(core.start, core.stop - core.start)
        return pa.table(
            {**{c: kept.column(c) for c in passed},
             **{n: list_of(result[n][core], element[t][1]) for n, t in outputs.items()}}
        )

    return map_groups(source, [*keys, "band"], ["y"], lambda groups: [one_band(t) for t in groups], schema)


def reduce_bands(
    scan: DataFrame,
    kernel: Callable[[Planes, slice], Mapping[str, float]],
    radius: int,
    inputs: Sequence[str],
    outputs: Mapping[str, str],
    keys: Sequence[str] = (PAGE,),
    rows: int = BAND_ROWS,
    levels: Sequence[str] = (),
    whole: bool = False,
) -> DataFrame:
    """One row of partial sums per band; ``kernel`` gets the planes and the owned rows."""
    types = {"bigint": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64())}
    names, page_keys = list(inputs), list(keys)
    source = _banded(scan.select(*page_keys, "y", *_travelling(names, levels)), radius, rows, page_keys, whole)
    schema = T.StructType(
        [source.schema[c] for c in keys] + [T.StructField(n, types[t][0]) for n, t in outputs.items()]
    )

    def one_band(table: pa.Table) -> pa.Table | None:
        core = _owned(table, rows)
        if core is None:
            return None
        sums = kernel(_planes(table, names), core)
        return pa.table(
            {**{c: table.column(c).slice(0, 1) for c in page_keys},
             **{n: pa.array([sums[n]], types[t][1]) for n, t in outputs.items()}}
        )

    return map_groups(source, [*keys, "band"], ["y"], lambda groups: [one_band(t) for t in groups], schema)


# --- arithmetic of one band ---------------------------------------------------------------------


def to_level(values: np.ndarray) -> np.ndarray:
    """Half-up rounding with a little slack, so the order of a float sum cannot change a pixel."""
    return np.floor(values + (0.5 + 1e-9)).astype(np.int32)


def gaussian_taps(size: int, sigma: float) -> np.ndarray:
    at = np.arange(size) - (size - 1) / 2
    weights = np.exp(-(at**2) / (2 * sigma * sigma))
    return weights / weights.sum()


def taps_for_sigma(sigma: float) -> int:
    """Kernel size for 8-bit data when only sigma is given."""
    return int(round(sigma * 6 + 1)) | 1


def sigma_for_taps(size: int) -> float:
    """Sigma when only the kernel size is given."""
    return 0.3 * ((size - 1) * 0.5 - 1) + 0.8


def smooth(plane: np.ndarray, taps: np.ndarray, border: str, lines: Lines | None = None) -> np.ndarray:
    """Separable weighted mean; ``border`` is ``edge`` (replicate) or ``reflect`` (edge pixel once).

    With ``lines``, rows lie at their places and missing ones count as zero.
    """
    r = len(taps) // 2
    height, width = plane.shape
    wide = np.pad(plane.astype(np.float64), ((0, 0), (r, r)), mode=border)
    across = sum(w * wide[:, k : k + width] for k, w in enumerate(taps))
    if lines is not None:
        return _smooth_down(across, taps, border, lines)
    tall = np.pad(across, ((r, r), (0, 0)), mode=border)
    return sum(w * tall[k : k + height] for k, w in enumerate(taps))


def _smooth_down(across: np.ndarray, taps: np.ndarray, border: str, lines: Lines) -> np.ndarray:
    """The vertical pass by place; runs of lines too far apart to meet are worked on one by one."""
    r, out = len(taps) // 2, np.zeros(across.shape)
    cuts = [0, *(np.flatnonzero(np.diff(lines.y) > 2 * r) + 1).tolist(), len(lines.y)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = lines.y[lo:hi]
        places = np.arange(int(at[0]) - r, int(at[-1]) + r + 1)
        if border == "edge":
            places = np.clip(places, 0, lines.last)
        else:
            period = max(2 * lines.last, 1)
            places = np.minimum(places % period, period - places % period) if lines.last else np.zeros_like(places)
        found = np.minimum(np.searchsorted(at, places), len(at) - 1)
        tall = np.where((at[found] == places)[:, None], across[lo:hi][found], 0.0)
        for k, w in enumerate(taps):
            out[lo:hi] += w * tall[at - at[0] + k]
    return out


def ellipse_spans(size: int) -> list[tuple[int, int]]:
    """(row offset, half width) pairs of the elliptic structuring element."""
    r = size // 2
    spans = []
    for dy in range(-r, r + 1):
        spans.append((dy, int(np.rint(r * np.sqrt((r * r - dy * dy) / (r * r)))) if r else 0))
    return spans


def spread(plane: np.ndarray, spans: Sequence[tuple[int, int]], grow: bool) -> np.ndarray:
    """Moving maximum (``grow``) or minimum over the element; pixels outside the page do not count."""
    pick, neutral = (np.maximum, -1) if grow else (np.minimum, 1 << 30)
    ry, rx = max(abs(dy) for dy, _ in spans), max(dx for _, dx in spans)
    height, width = plane.shape
    padded = np.pad(plane.astype(np.int32), ((ry, ry), (rx, rx)), constant_values=neutral)
    out = np.full(plane.shape, neutral, dtype=np.int32)
    for dy, half in spans:
        for dx in range(-half, half + 1):
            pick(out, padded[ry + dy : ry + dy + height, rx + dx : rx + dx + width], out=out)
    return out
