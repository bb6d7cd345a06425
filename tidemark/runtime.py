"""Session-level helpers: table access, the shared working folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
# Names this process's intermediate tables in the shared folder; they go when it ends.
_RUN = uuid.uuid4().hex
_RUN_DIRS: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    importable(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where that setting is absent and the
    session is local, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        folder = tempfile.mkdtemp(prefix="tidemark-")
        _OWN_DIRS[key] = f"file://{folder}"
        atexit.register(_remove, folder)
    return _OWN_DIRS[key]


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def run_dir(spark: SparkSession) -> str:
    """This process's part of the shared folder; removed when the process ends, as far as it can be reached then."""
    folder = f"{shared_dir(spark)}/tidemark/run-{_RUN}"
    if folder not in _RUN_DIRS:
        _RUN_DIRS.add(folder)
        atexit.register(_remove_run, folder)
    return folder


def _remove_run(folder: str) -> None:
    from pyarrow import fs

    try:
        filesystem, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        filesystem.delete_dir(path)
    except Exception:  # a folder out of reach, or nothing was written
        pass


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that the loss of an executor never re-runs what came
    before, and keeps columns prunable (unlike a checkpointed RDD).
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """Uniform [0, 1) number that depends only on the columns' values and ``seed``."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def text_unit(*cols: Column | str, seed: int = 0) -> Column:
    """As :func:`hash_unit`, from the MD5 of the values as text, so that other engines can follow it."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in cols]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def norm_split(col: Column | str) -> Column:
    """Split names compare without regard to case and surrounding blanks."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``df``; extra columns, whatever their names, go."""
    return df.select(*[F.col(f"`{n}`") for n in names])
