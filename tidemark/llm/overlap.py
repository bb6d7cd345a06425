"""Images of evaluation splits that are in the training split too, equal or nearly so."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import norm_split, staged

FINE_BANDS, FINE_GROUPS = 8, 4
STEP, SCALE, MOST_SEGMENTS = 8, 256, 4
#: Signs of four bands of rows and of two groups of columns, the inner and the outer half.
PATTERNS = tuple((np.array(r), np.array(g)) for r, g in (([1, 1, 1, 1], [1, 1]), ([1, 1, -1, -1], [1, 1]), ([1, -1, -1, 1], [1, 1]), ([1, 1, 1, 1], [1, -1]), ([1, 1, -1, -1], [1, -1]), ([1, -1, 1, -1], [1, 1])))
CELLS = FINE_BANDS * FINE_GROUPS
WORDS = CELLS // 4


def _folded(h: int, w: int, bands: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Band of each row, and group of each column: columns equally far from an edge share one."""
    return np.arange(h) * bands // h, np.minimum(np.arange(w), np.arange(w)[::-1]) * groups // ((w + 1) // 2)


def cell_sums(images: np.ndarray) -> np.ndarray:
    """Sums [n, 32] of images [n, c, h, w] in cells that mirroring left to right leaves alone.

    Eight bands of rows by four groups of columns, over all channels, in 1/256
    of the image's number of bytes, rounded down. The absolute differences of
    two images' bytes sum up to no less than those of their cells; see
    :func:`cell_limit` for the rounding. Cells without rows or columns are 0.
    """
    n, c, h, w = images.shape
    band, group = _folded(h, w, FINE_BANDS, FINE_GROUPS)
    cell = (band[:, None] * FINE_GROUPS + group).ravel()
    sums = images.sum(axis=1, dtype=np.int64).reshape(n, -1)
    out = np.stack([sums[:, cell == k].sum(axis=1) for k in range(CELLS)], axis=1)
    return out * SCALE // (c * h * w)


def cell_limit(most: float) -> int:
    """The largest sum of differences of :func:`cell_sums` at an average difference of ``most``: rounding adds less than 1 a cell."""
    return int(np.ceil(most * SCALE)) + CELLS


def packed_cells(sums: np.ndarray) -> np.ndarray:
    """The cells of each row, four of 16 bits in a word [n, WORDS]."""
    return np.ascontiguousarray(sums.astype(">u2")).view(">i8").astype(np.int64)


def _cells_apart() -> Column:
    """Sum of the absolute differences of the cells of a row and of one of the other side."""

    def cell(name: str, k: int) -> Column:
        return F.shiftrightunsigned(F.col(name), 16 * k).bitwiseAND(F.lit(0xFFFF))

    return sum((F.abs(cell(f"cells{i}", k) - cell(f"cells{i}_t", k)) for i in range(WORDS) for k in range(4)), F.lit(0))


def _mix(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(parts[0].shape, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def segment_codes(images: np.ndarray, most: float, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each segment of each image [n, c, h, w].

    A segment is a channel (of more than four channels, one of four runs of
    them). If two images differ by an average of at most ``most``, they do so in
    some segment, and then no sum of the segment's bytes under signs differs by
    more than ``most`` times its bytes. The code has six such sums, under
    signs that mirroring leaves alone, each rounded down to steps. ``wide``
    gives every code that sums within that bound could have, else only the own
    one comes out; so two such images always share a code of one's wide and the
    other's own. All is in whole numbers.
    """
    n, c, h, w = images.shape
    band, group = _folded(h, w, 4, 2)
    segments = min(c, MOST_SEGMENTS)
    segment = np.arange(c) * segments // c
    rows, codes = [], []
    for s in range(segments):
        size = int((segment == s).sum()) * h * w
        pixels = images[:, segment == s].sum(axis=1, dtype=np.int64)
        slack, step = int(np.floor(most * size)) if wide else 0, STEP * size
        row = np.arange(n)
        code = _mix([np.full(n, v) for v in (c, h, w, s)])
        for by_band, by_group in PATTERNS:
            total = (pixels * (by_band[band][:, None] * by_group[group])).sum(axis=(1, 2))
            low, high = ((total - slack) // step)[row], ((total + slack) // step)[row]
            count = high - low + 1
            at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, code = np.repeat(row, count), _mix([np.repeat(code, count), at])
        rows.append(row)
        codes.append(code)
    return np.concatenate(rows), np.concatenate(codes)


def _by_shape(batch: pa.RecordBatch, first: int):
    """Rows of each shape of a batch, whose columns from ``first`` are channels, height, width."""
    shape = np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
    kinds, inverse = np.unique(shape, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    for k, s in enumerate(kinds):
        yield tuple(int(v) for v in s), np.flatnonzero(inverse == k)


def _pixels(column: pa.Array, rows: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), *shape)


def _coded(contents: DataFrame, most: float, wide: bool) -> DataFrame:
    words = [f"cells{i}" for i in range(WORDS)]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                for shape, rows in _by_shape(part, 1):
                    images = _pixels(part.column(4), rows, shape)
                    cells = packed_cells(cell_sums(images))
                    row, code = segment_codes(images, most, wide)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[row])), pa.array(code), *[pa.array(cells[row, i]) for i in range(WORDS)]], ["cid", "code", *words])

    return contents.select("cid", "channels", "height", "width", "data").mapInArrow(run, "cid bigint, code bigint, " + ", ".join(f"{w} bigint" for w in words))


def _close(pairs: DataFrame, most: float) -> DataFrame:
    """Of content pairs with both ``data``, those at most ``most`` apart, straight or mirrored."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for shape, rows in _by_shape(b, 2):
                for s in range(0, len(rows), 4096):
                    part = rows[s : s + 4096]
                    x, y = _pixels(b.column(5), part, shape).astype(np.int16), _pixels(b.column(6), part, shape).astype(np.int16)
                    n = x[0].size
                    straight = np.abs(x - y).sum(axis=(1, 2, 3), dtype=np.int64)
                    mirrored = np.abs(x - y[:, :, :, ::-1]).sum(axis=(1, 2, 3), dtype=np.int64)
                    keep[part] = np.minimum(straight, mirrored) <= most * n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "channels", "height", "width", "data_a", "data_b").mapInArrow(run, "a string, b string")


def split_overlap(datum: DataFrame, most: float = 3.0) -> DataFrame:
    """Pairs of a train record and a val or test record with nearly equal images.

    Returns ``train_id, other_id, split, source`` (split and source of the
    other record), each pair once. Images count as nearly equal if they have
    the same channels, height and width and an average absolute difference of
    the byte values of at most ``most``, straight or mirrored left to right.

    Equal images are one content, however many copies there are. Contents of
    the two sides meet where they share a code of a segment
    (:func:`segment_codes`) and their cells differ by no more than ``most``
    allows (:func:`cell_sums`), tested inside the join. What remains is
    compared byte by byte. Both tests follow from the bound on the average, so
    no pair is lost. Codes and cells ignore mirroring, so one search does for
    both. Hot codes are split by the adaptive join.

    Records without a full shape, with null or empty data or data of another
    length, and with a null or other split take no part; null sources stay
    null. Repeated ``datum_id`` count once. Empty tables give no rows.
    """
    d = datum.select(F.col("datum_id"), norm_split("split").alias("split"), "source", "channels", "height", "width", "data")
    size = F.col("channels").cast("bigint") * F.col("height") * F.col("width")
    d = d.where("datum_id is not null and split in ('train', 'val', 'test')").where((F.octet_length("data") > 0) & (F.octet_length("data") == size) & (F.col("channels") > 0) & (F.col("height") > 0))
    d = d.withColumn("content", F.md5("data"))
    shape = ["channels", "height", "width"]
    train = F.col("split") == "train"
    contents = staged(d.groupBy("content", *shape).agg(F.first("data").alias("data"), F.max(train).alias("in_train"), F.max(~train).alias("in_other")), "p2-contents")
    key = F.md5(F.concat_ws("x", *shape, "content"))
    # Codes travel with a 64-bit hash of the content; contents that should share one are told apart by the comparison.
    contents = contents.withColumn("content", key).withColumn("cid", F.xxhash64("content"))
    left = _coded(contents.where("in_other"), most, True)
    right = _coded(contents.where("in_train"), most, False)
    right = right.select(*[F.col(c).alias(f"{c}_t") for c in right.columns])
    met = left.join(right, (F.col("code") == F.col("code_t")) & (F.col("cid") != F.col("cid_t")) & (_cells_apart() <= cell_limit(most)))
    pairs = staged(met.select("cid", "cid_t").distinct(), "p2-candidates")
    side_a = contents.where("in_other").select("cid", F.col("content").alias("a"), *shape, F.col("data").alias("data_a"))
    side_b = contents.where("in_train").select(F.col("cid").alias("cid_t"), F.col("content").alias("b"), *[F.col(c).alias(f"{c}_t") for c in shape], F.col("data").alias("data_b"))
    alike = pairs.join(side_a, "cid").join(side_b, "cid_t").where(" and ".join(f"{c} = {c}_t" for c in shape))
    close = _close(alike, most)
    same = contents.where("in_train and in_other").select(F.col("content").alias("a"), F.col("content").alias("b"))
    links = close.unionByName(same)
    members = d.select(key.alias("content"), "datum_id", "split", "source", train.alias("is_train")).distinct()
    other = members.where("not is_train").select(F.col("content").alias("a"), F.col("datum_id").alias("other_id"), "split", "source")
    trained = members.where("is_train").select(F.col("content").alias("b"), F.col("datum_id").alias("train_id"))
    return links.join(other, "a").join(trained, "b").select("train_id", "other_id", "split", "source").dropDuplicates(["train_id", "other_id"])


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """Pairs, and evaluation and train records in them, per split and source of the evaluation record."""
    by = ["split", "source"]
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("other_id").alias("records"), F.count_distinct("train_id").alias("train_records"))
