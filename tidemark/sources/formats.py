"""Readers and writers of the vector and matrix formats, as DataFrames.

Readers never look at labels' or ids' ranges beyond what the format says; a
line or record that isn't of the format raises an error that names it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import importable

SPARSE = "label int, ids array<int>, vals array<float>"


# ---- libsvm -----------------------------------------------------------------


def parse_libsvm(lines: DataFrame, feature_one_based: bool = False, label_one_based: bool = False) -> DataFrame:
    """``label, ids, vals`` of lines ``label id:val …`` (column ``value``); blank lines are dropped, a label alone has no features."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(parts.alias("p"))
    pairs = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda s: F.split(s, ":"))
    shift = 1 if feature_one_based else 0
    return rows.select(
        (F.get("p", F.lit(0)).cast("double").cast("int") - (1 if label_one_based else 0)).alias("label"),
        F.transform(pairs, lambda q: q[0].cast("int") - shift).alias("ids"),
        F.transform(pairs, lambda q: q[1].cast("float")).alias("vals"),
    )


def read_libsvm(spark: SparkSession, paths: str | list[str], feature_one_based: bool = False, label_one_based: bool = False) -> DataFrame:
    return parse_libsvm(spark.read.text(paths), feature_one_based, label_one_based)


def dense_of(ids: Column | str, vals: Column | str, dim: int) -> Column:
    """A sparse vector as an array of ``dim`` floats; ids outside are dropped."""
    m = F.map_from_arrays(F.col(ids) if isinstance(ids, str) else ids, F.col(vals) if isinstance(vals, str) else vals)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0).cast("float")))


def read_libsvm_dense(spark: SparkSession, paths: str | list[str], dim: int, **options) -> DataFrame:
    return read_libsvm(spark, paths, **options).select("label", dense_of("ids", "vals", dim).alias("x"))


def write_libsvm(df: DataFrame, path: str, feature_one_based: bool = False, label_one_based: bool = False) -> None:
    """One line per row of ``label, ids, vals``."""
    shift = 1 if feature_one_based else 0
    cells = F.zip_with("ids", "vals", lambda i, v: F.concat_ws(":", (i + shift).cast("string"), v.cast("string")))
    df.select(F.concat_ws(" ", (F.col("label") + (1 if label_one_based else 0)).cast("string"), F.array_join(cells, " ")).alias("value")).select(F.rtrim("value").alias("value")).write.mode("overwrite").text(path)


def read_shards(spark: SparkSession, prefix: str, client: int, files_per_client: int, skip: int = 0, **options) -> DataFrame:
    """A client's share of numbered files; rows without features are dropped.

    File i of the share has the number ``(files_per_client + skip) * client + i``;
    reading ends at the first that is missing.
    """
    import os

    paths = []
    for i in range(files_per_client):
        p = f"{prefix}.{(files_per_client + skip) * client + i}"
        if not os.path.exists(p.removeprefix("file://")):
            break
        paths.append(p)
    if not paths:
        return spark.createDataFrame([], SPARSE)
    return read_libsvm(spark, paths, **options).where(F.size("ids") > 0)


# ---- binary records ---------------------------------------------------------


def _files(spark: SparkSession, paths: str | list[str], compressed: bool, parse, schema: str) -> DataFrame:
    """Records of binary files; a file is read by one task, which yields bounded batches."""
    importable(spark)

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from parse(unsnap(data) if compressed else data)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, schema)


def unsnap(data: bytes) -> bytes:
    """A raw Snappy block; its length stands in front as a variable-length number."""
    size, shift = 0, 0
    for byte in data[:6]:
        size |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            break
    return pa.decompress(data, size, codec="snappy", asbytes=True)


def read_dense_binary(spark: SparkSession, paths: str | list[str], dim: int, compressed: bool = False) -> DataFrame:
    """``label, x`` of records int32 label + ``dim`` float32. Values are never shifted, whatever the ids' base."""
    kind = np.dtype([("label", "<i4"), ("x", "<f4", (dim,))])

    def parse(data: bytes):
        if len(data) % kind.itemsize:
            raise ValueError(f"{len(data)} bytes are no whole number of records of {kind.itemsize}")
        rows = np.frombuffer(data, kind)
        for s in range(0, len(rows), 10_000):
            part = rows[s : s + 10_000]
            offsets = pa.array(np.arange(len(part) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(part["label"]), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(part["x"]).ravel()))], ["label", "x"])

    return _files(spark, paths, compressed, parse, "label int, x array<float>")


def read_sparse_binary(spark: SparkSession, paths: str | list[str], compressed: bool = False) -> DataFrame:
    """``label, ids, vals`` of records int32 count, int32 label, count int32 ids, count float32 values."""

    def parse(data: bytes):
        at, labels, ids, vals, ends = 0, [], [], [], [0]

        def batch():
            o = pa.array(ends, pa.int32())
            cat = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
            return pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.ListArray.from_arrays(o, pa.array(cat(ids, "i4"))), pa.ListArray.from_arrays(o, pa.array(cat(vals, "f4")))], ["label", "ids", "vals"])

        while at < len(data):
            n, label = struct.unpack_from("<ii", data, at)
            at += 8
            if n < 0 or at + 8 * n > len(data):
                raise ValueError(f"record cut off at byte {at}")
            ids.append(np.frombuffer(data, "<i4", n, at))
            vals.append(np.frombuffer(data, "<f4", n, at + 4 * n))
            at += 8 * n
            labels.append(label)
            ends.append(ends[-1] + n)
            if len(labels) == 10_000:
                yield batch()
                labels, ids, vals, ends = [], [], [], [0]
        if labels:
            yield batch()

    return _files(spark, paths, compressed, parse, SPARSE)


def dense_record(label: int, x) -> bytes:
    return struct.pack("<i", label) + np.asarray(x, "<f4").tobytes()


def sparse_record(label: int, ids, vals) -> bytes:
    return struct.pack("<ii", len(ids), label) + np.asarray(ids, "<i4").tobytes() + np.asarray(vals, "<f4").tobytes()


# ---- meta files -------------------------------------------------------------


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """``name: value`` lines as a map; the last of equal names counts. A meta file is a page of text."""
    rows = spark.read.text(path).where(F.instr("value", ":") > 0).select(F.trim(F.substring_index("value", ":", 1)).alias("k"), F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("v"))
    return {r.k: r.v for r in rows.collect()}


def meta_flag(meta: dict[str, str], name: str) -> bool:
    """Flags are true if their value is ``1``."""
    return meta.get(name) == "1"


# ---- matrices ---------------------------------------------------------------


def read_coo_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``i, j, x`` of lines ``row col value``."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(paths).where(F.trim("value") != "").select(p[0].cast("int").alias("i"), p[1].cast("int").alias("j"), p[2].cast("float").alias("x"))


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """Entries as they stand (ids aren't shifted) and the header's rows, columns and count."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("at"))
    head = lines.orderBy("at").first()
    dims = tuple(int(v) for v in head.value.split())
    p = F.split("value", r"\s+")
    rows = lines.where(F.col("at") != head.at).select(p[0].cast("int").alias("i"), p[1].cast("int").alias("j"), p[2].cast("float").alias("x"))
    return rows, dims


def read_rows_libsvm(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """``i, j, x`` of a file whose first line is ``N M`` and whose line i is ``count col:val …``; counts are checked."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    head = lines.where("n = 0").first().line.split()
    p = F.split(F.trim("line"), r"\s+")
    rows = lines.where((F.col("n") > 0) & (F.trim("line") != "")).select((F.col("n") - 1).cast("int").alias("i"), p.alias("p"))
    ok = F.when(F.get("p", F.lit(0)).cast("int") == F.size("p") - 1, F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).otherwise(F.raise_error(F.concat(F.lit("wrong count in row "), F.col("i").cast("string"))))
    cells = rows.select("i", F.explode(F.transform(ok, lambda s: F.split(s, ":"))).alias("c"))
    return cells.select("i", F.col("c")[0].cast("int").alias("j"), F.col("c")[1].cast("float").alias("x")), (int(head[0]), int(head[1]))


def coo_block(i, j, x, rows: int, cols: int) -> bytes:
    """A partition of a matrix: three 8-byte numbers (count, rows, cols), then ids and values as arrays."""
    return struct.pack("<QQQ", len(i), rows, cols) + np.asarray(i, "<i4").tobytes() + np.asarray(j, "<i4").tobytes() + np.asarray(x, "<f4").tobytes()


def read_coo_binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``i, j, x`` of partition files."""

    def parse(data: bytes):
        n, _, _ = struct.unpack_from("<QQQ", data)
        if len(data) != 24 + 12 * n:
            raise ValueError(f"{len(data)} bytes don't hold {n} entries")
        i, j, x = np.frombuffer(data, "<i4", n, 24), np.frombuffer(data, "<i4", n, 24 + 4 * n), np.frombuffer(data, "<f4", n, 24 + 8 * n)
        for s in range(0, n, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[s : s + 100_000]) for v in (i, j, x)], ["i", "j", "x"])

    return _files(spark, paths, False, parse, "i int, j int, x float")


def read_matrix_text(spark: SparkSession, path: str, clients: int = 1) -> DataFrame:
    """``i, j, x, client`` of lines of values; column j belongs to client j mod ``clients``."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("i", "line")).where(F.trim("line") != "")
    cells = lines.select("i", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "v"))
    return cells.select("i", "j", F.col("v").cast("float").alias("x"), (F.col("j") % clients).alias("client"))


def small_to_zero(x: Column | str, least: float = 1e-5) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(c) < least, 0.0).otherwise(c)


# ---- text corpora -----------------------------------------------------------


def read_word_counts(spark: SparkSession, paths: str | list[str], vocabulary: int = 160_024) -> DataFrame:
    """``doc_id, word, n`` of libsvm word counts; labels are ignored, words beyond the vocabulary dropped.

    Documents get ids that are unique but not consecutive.
    """
    docs = read_libsvm(spark, paths).withColumn("doc_id", F.monotonically_increasing_id())
    cells = docs.select("doc_id", F.explode(F.arrays_zip("ids", "vals")).alias("c"))
    return cells.where((F.col("c.ids") < vocabulary) & (F.col("c.ids") >= 0)).select("doc_id", F.col("c.ids").alias("word"), F.col("c.vals").cast("int").alias("n"))


# ---- models and results -----------------------------------------------------


def write_weights(weights: DataFrame, path: str, labels: int, dim: int) -> None:
    """A class's weights per line as ``id:val `` after a header; ``weights(k, fid, w)``. Models are of fixed size: one file."""
    line = weights.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("fid", "w"))).alias("c"))
    body = line.select(F.col("k").alias("at"), F.concat(F.array_join(F.transform("c", lambda e: F.concat_ws(":", e["fid"].cast("string"), e["w"].cast("string"))), " "), F.lit(" ")).alias("value"))
    head = weights.sparkSession.createDataFrame([(-2, f"num_labels: {labels}"), (-1, f"feature_dim: {dim}")], "at int, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def read_weights(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """``k, fid, w`` and the header's numbers of classes and features."""
    lines = spark.read.text(path, wholetext=True).where(F.trim("value") != "").select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    head = {r.n: r.line for r in lines.where("n < 2").collect()}
    cells = lines.where((F.col("n") > 1) & (F.trim("line") != "")).select((F.col("n") - 2).alias("k"), F.explode(F.split(F.trim("line"), r"\s+")).alias("c"))
    rows = cells.select("k", F.split("c", ":")[0].cast("int").alias("fid"), F.split("c", ":")[1].cast("double").alias("w"))
    return rows, int(head[0].split(":")[1]), int(head[1].split(":")[1])


def write_rows(df: DataFrame, key: str, values: str, path: str, with_key: bool = False) -> None:
    """Rows of an array column as lines of values, in the order of the key within files; with the key in front if asked for."""
    text = F.array_join(F.col(values).cast("array<string>"), " ")
    df.repartitionByRange(key).sortWithinPartitions(key).select((F.concat_ws(" ", F.col(key).cast("string"), text) if with_key else text).alias("value")).write.mode("overwrite").text(path)


def write_history(df: DataFrame, path: str) -> None:
    """One line per evaluation, with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# ---- streams of files -------------------------------------------------------


def stream_files(spark: SparkSession, where: str, mode: str = "dir", count: int = 0) -> list[str]:
    """Files of a stream: a folder's, sorted, without hidden ones; those a list file names; or a numbered sequence."""
    import os

    if mode == "dir":
        return [os.path.join(where, n) for n in sorted(os.listdir(where)) if not n.startswith(".")]
    if mode == "list":
        return [r.value.strip() for r in spark.read.text(where).collect() if r.value.strip()]
    if mode == "sequence":
        return [f"{where}{i}" for i in range(count)]
    raise ValueError(f"no mode {mode!r}")


def read_passes(spark: SparkSession, paths: list[str], passes: int) -> DataFrame:
    """Lines of all files, once per pass, with the pass's number."""
    return spark.read.text(paths).select("value", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")) if passes > 0 else spark.createDataFrame([], "value string, pass int")


# ---- synthetic data ---------------------------------------------------------


def synthetic_sparse(spark: SparkSession, rows: int, dim: int, per_row: int, labels: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """``id, label, ids, vals``: random sparse rows whose label is the quantile bucket of a random linear score; some labels are noise."""
    from tidemark.operators.partition import quantile_labels
    from tidemark.runtime import hash_unit

    u = lambda *c, s: hash_unit(*c, seed=seed * 1000 + s)
    base = spark.range(rows)
    ids = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda k: F.floor(u(F.col("id"), k, s=1) * dim).cast("int"))))
    x = base.select("id", ids.alias("ids")).withColumn("vals", F.transform("ids", lambda i: (u(F.col("id"), i, s=2) * 2 - 1).cast("float")))
    score = F.aggregate(F.zip_with("ids", "vals", lambda i, v: v.cast("double") * (u(i, s=3) * 2 - 1)), F.lit(0.0), lambda s, v: s + v)
    labelled = quantile_labels(x.withColumn("score", score), "score", labels, "id")
    label = F.when(u(F.col("id"), s=4) < noise, F.floor(u(F.col("id"), s=5) * labels)).otherwise(F.col("label"))
    return labelled.select("id", label.cast("int").alias("label"), "ids", "vals")
