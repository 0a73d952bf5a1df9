"""A quality classifier: random Fourier features, ridge regression and isotonic calibration.

Documents are reduced to statistics of their whole text. A Gaussian kernel over the standardized statistics
is approximated by random Fourier features, whose frequencies follow from a seed. Every partition sums its
normal equations, Spark sums those of all partitions row by row, and only the final system of
``FEATURES + 1`` rows per fold reaches the driver. Four folds give scores from models that have not seen the
document; on these an isotonic curve maps scores to probabilities (from a histogram of ``BINS`` score bins,
so its size does not depend on the data). Every labelled row outside the held-out part is used.

Labels, language, source and doc_id are no inputs of a score.

Defined results: null and empty texts have all statistics zero and are scored like any other. Label rows
without an id or with a quality other than 0 and 1 are left out; repeated label rows count each. With no
labels, or labels of one class only, every score is that class's share (0.5 with none). A null doc_id is
scored and not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.words import find_words, hash_ranges, hash_words, mix, text_buffer
from foliolake.session import checkpointed

FOLDS = 5
FEATURES = 384
WIDTH = 2.0  # kernel width in units of the square root of the number of statistics
RIDGE = 1e-4
BINS = 2000
SEED = 20240501
THRESHOLD = 0.3
#: Bytes of text whose statistics are taken at once.
SLICE = 2 << 20

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "stop": b".,;:", "mark": b"!?", "symbol": b"#*$%&|<>", "bracket": b"()[]{}\"'", "line": b"\n",
    "space": b" \t\r\x0b\x0c", "other": bytes(range(128, 256)), "at": b"@/\\_=+-~^`",
}
_CLASS = np.zeros(256, np.uint8)
for _i, _members in enumerate(_CLASSES.values(), 1):
    _CLASS[list(_members)] = _i
_LINE = np.ones(256, bool)
_LINE[10] = False
STATISTICS = (
    "log_bytes", "log_words", "log_lines", *(f"{c}_ratio" for c in _CLASSES), "word_length", "word_spread",
    "distinct_words", "top_word", "next_word_equal", "capital_words", "shouted_words", "distinct_lines",
    "words_per_line",
)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct hashes, and the count of its commonest one."""
    keys = np.sort(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | (
        owner.astype(np.uint64) << np.uint64(44)))
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.append(begin, len(keys)))
    texts = (keys[begin] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, texts, counts)
    return np.bincount(texts, minlength=n).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    words, lines = find_words(texts), find_words(texts, is_word=_LINE)
    size = np.diff(offsets).astype(float)
    n_words, n_lines = np.diff(words.first).astype(float), np.diff(lines.first).astype(float)
    per = lambda a, b: a / np.maximum(b, 1.0)
    kinds = _CLASS[data]
    ratios = [per(_sums(kinds == k, offsets), size) for k in range(1, len(_CLASSES) + 1)]
    length = (words.ends - words.starts).astype(float)
    mean = per(_sums(length, words.first), n_words)
    spread = np.sqrt(np.maximum(per(_sums(length**2, words.first), n_words) - mean**2, 0))
    hashes, owner = hash_words(words), words.text_of()
    distinct, top = _distinct(hashes, owner, n)
    equal = np.zeros(len(hashes))
    equal[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    upper = kinds == 1
    capital = upper[words.starts] if len(hashes) else np.zeros(0)
    uppers = np.concatenate(([0], np.cumsum(upper)))
    shouted = (uppers[words.ends] - uppers[words.starts]) * 2 > length
    n_distinct_lines, _ = _distinct(hash_ranges(lines.data, lines.starts, lines.ends), lines.text_of(), n)
    columns = [
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), *ratios, mean, spread,
        per(distinct, n_words), per(top, n_words), per(_sums(equal, words.first), n_words),
        per(_sums(capital, words.first), n_words), per(_sums(shouted, words.first), n_words),
        per(n_distinct_lines, n_lines), np.log1p(per(n_words, n_lines)),
    ]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(columns)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum([len(t) if (t := x.as_buffer()) else 0 for x in batch.column("text")])
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE)))
            part = batch.slice(low, high - low)
            rows = statistics(part.column("text"))
            flat = pa.array(rows.ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, rows.shape[1], dtype=np.int32), flat)
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "x"])
            low = high


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the array of statistics of every document."""
    return docs.select("doc_id", "text").mapInArrow(_measure, "doc_id bigint, x array<double>")


def fold_of(doc_id) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class FourierMap:
    """Standardized statistics to random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        draw = np.random.default_rng(seed)
        width = WIDTH * np.sqrt(len(mean))
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.frequencies = draw.normal(size=(len(mean), features)) / width
        self.phases = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)


def _equations(features: FourierMap, width: int):
    """Per partition and fold, the rows of Z'Z with Z'y as last entry."""

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            z = features(_matrix(batch.column("x"), width))
            zy = np.concatenate((z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]), axis=1)
            for fold in np.unique(folds):
                own = folds == fold
                total[int(fold)] = total.get(int(fold), 0.0) + z[own].T @ zy[own]
        for fold, rows in total.items():
            yield pa.record_batch(
                [pa.array([fold] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()),
                 pa.array(list(rows), pa.list_(pa.float64()))],
                names=["fold", "row", "values"],
            )

    return equations


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    values = table["values"].combine_chunks()
    summed = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).sum(axis=0)
    return pa.table(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
         pa.array([summed], pa.list_(pa.float64()))],
        names=["fold", "row", "values"],
    )


def ridge(equations: np.ndarray) -> np.ndarray:
    """Weights of summed normal equations; the constant is not penalized."""
    gram, target = equations[:, :-1], equations[:, -1]
    penalty = np.full(len(gram), RIDGE * max(gram[-1, -1], 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), target)


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The nondecreasing curve nearest to ``ones / counts``, by pooling adjacent violators.

    Bins without a row take a value between their neighbours'.
    """
    blocks: list[list[float]] = []  # weight, sum, bins
    used = np.flatnonzero(counts > 0)
    for k in used:
        blocks.append([counts[k], ones[k], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    values = np.repeat([b[1] / b[0] for b in blocks], [int(b[2]) for b in blocks])
    return np.interp(np.arange(len(counts)), used, values)


def _raw(features: FourierMap, weights: dict[int, np.ndarray], width: int, x, folds=None) -> np.ndarray:
    z = features(_matrix(x, width))
    if folds is None:
        return z @ weights[-1]
    return np.stack([z @ weights[k] for k in range(FOLDS)], axis=1)[np.arange(len(z)), folds]


def _bins(raw: np.ndarray) -> np.ndarray:
    """Bins over scores from -0.5 to 1.5; scores beyond belong to the outermost."""
    return np.clip(((raw + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)


def _calibration(features: FourierMap, weights: dict, width: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            place = _bins(_raw(features, weights, width, batch.column("x"), batch.column("fold").to_numpy(zero_copy_only=False)))
            n += np.bincount(place, minlength=BINS)
            ones += np.bincount(place, batch.column("y").to_numpy(zero_copy_only=False), minlength=BINS)
        used = np.flatnonzero(n)
        yield pa.record_batch(
            [pa.array(used, pa.int64()), pa.array(n[used]), pa.array(ones[used])], names=["bin", "n", "ones"]
        )

    return counted


def _scorer(features: FourierMap, weights: dict, curve: np.ndarray, width: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(features, weights, width, batch.column("x"))
            # Between bin centres the curve is read linearly.
            place = np.clip((raw + 0.5) * BINS / 2 - 0.5, 0, BINS - 1)
            values = np.clip(np.interp(place, np.arange(BINS), curve), 0.0, 1.0)
            held = [fold_of(i) == 0 for i in batch.column("doc_id").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(values),
                 pa.array((values >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return score


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    width = len(STATISTICS)
    rows = checkpointed(measured(docs))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select(
        F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")
    )
    train = checkpointed(rows.join(known, "doc_id").withColumn("fold", fold).filter("fold <> 0").select("x", "y", "fold"))
    shape = [F.avg(F.get("x", F.lit(k))) for k in range(width)] + [
        F.stddev_pop(F.get("x", F.lit(k))) for k in range(width)
    ]
    n, ones, *moments = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0)), *shape).first()
    if n == 0 or ones in (0, n):
        share = ones / n if n else 0.5
        held = F.coalesce(fold == 0, F.lit(False))
        return rows.select("doc_id", held.alias("held_out"), F.lit(share).alias("score"),
                           F.lit(int(share >= THRESHOLD)).alias("predicted"))
    features = FourierMap(np.array(moments[:width]), np.array(moments[width:]))
    partial = train.mapInArrow(_equations(features, width), "fold int, row int, values array<double>")
    summed = partial.groupBy("fold", "row").applyInArrow(_add, "fold int, row int, values array<double>").toPandas()
    parts = {
        int(k): np.stack(part.sort_values("row")["values"].to_list()) for k, part in summed.groupby("fold")
    }
    total = sum(parts.values())
    weights = {k: ridge(total - parts.get(k, 0.0)) for k in range(FOLDS)} | {-1: ridge(total)}
    bins = (
        train.mapInArrow(_calibration(features, weights, width), "bin bigint, n double, ones double")
        .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toPandas()
    )
    counts, sums = np.zeros(BINS), np.zeros(BINS)
    counts[bins["bin"]], sums[bins["bin"]] = bins["n"], bins["ones"]
    return rows.mapInArrow(_scorer(features, weights, isotonic(counts, sums), width), SCHEMA)
