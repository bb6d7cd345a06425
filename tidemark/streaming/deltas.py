"""Increment streams: sums, pushes per clock, windows, and stateful step sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.runtime import importable, shared_dir


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the files of a Parquet table, with the table's own schema."""
    importable(spark)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(str(where.getParent().toString()))
    return reader.parquet(path)


def drain(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over all there is now; the last value of each key.

    Every micro-batch is written under its number in the shared folder, so a
    batch that is repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"

    def push(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(push).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    names = stream.columns
    out = _read_batches(spark, base, stream)
    if not keys:
        return out.select(*names)
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return last.select("r.*")


def _read_batches(spark: SparkSession, base: str, stream: DataFrame) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/out")


def sum_stream(increments: DataFrame) -> DataFrame:
    """Running sums per cell; late increments always count, since they commute."""
    return increments.groupBy("row_id", "col_id").agg(F.sum("delta").alias("value"))


def clock_stream(increments: DataFrame) -> DataFrame:
    """What each clock of each worker adds: the push that goes out when a clock is complete."""
    return increments.groupBy("clock", "worker").agg(F.sum("delta").alias("total"), F.count(F.lit(1)).alias("n"))


def window_stream(events: DataFrame, time: str, width: str, lateness: str | None = None) -> DataFrame:
    """Counts per tumbling window of event time.

    With ``lateness``, state older than the watermark is dropped, and so are
    rows that come later than that. Without it every row counts, in whatever
    order files come, and the state is one count a window.
    """
    timed = events.withWatermark(time, lateness) if lateness else events
    return timed.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


STATE = "g_sum double, z double, zmax double, value double"


def adarevision_stream(gradients: DataFrame, eta0: float = 0.1) -> DataFrame:
    """AdaRevision per cell with the cell's state kept between batches.

    ``gradients(row_id, col_id, seq, g, g_old)``; ``g_old`` is the sum of the
    cell's gradients that the sender had seen, null for all of them. Emits each
    cell's ``value`` after the batch.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, z, zmax, value = state.get if state.exists else (0.0, 1.0, 1.0, 0.0)
        pdf = pd.concat(list(parts)).sort_values("seq")
        n = len(pdf)
        for u, old in zip(pdf["g"], pdf["g_old"]):
            unseen = 0.0 if pd.isna(old) else total - old
            before = eta0 / zmax**0.5
            z += u * (u + 2 * unseen)
            zmax = max(zmax, z)
            eta = eta0 / zmax**0.5
            value += -eta * u + (before - eta) * unseen
            total += u
        state.update((total, z, zmax, value))
        yield pd.DataFrame({"row_id": [key[0]], "col_id": [key[1]], "value": [value], "n": [n]})

    return gradients.groupBy("row_id", "col_id").applyInPandasWithState(run, "row_id int, col_id int, value double, n long", STATE, "update", GroupStateTimeout.NoTimeout)
