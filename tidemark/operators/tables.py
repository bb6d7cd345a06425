"""A group of tables with one vector clock: create, increment, tick, read."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clocks as C
from tidemark.operators import deltas as D
from tidemark.runtime import run_dir
from tidemark.sources import snapshots

LOG = "row_id int, col_id int, delta double, worker int, clock int"
ROW_KINDS = ("dense", "sparse", "multiplicative")


@dataclass(frozen=True)
class TableSpec:
    """What stays fixed for a table's life."""

    row_kind: str = "sparse"
    capacity: int = 0
    staleness: int = 0


@dataclass
class Table:
    """One table: a log of increments per clock, and what workers have not shipped yet."""

    group: TableGroup
    table_id: int
    spec: TableSpec
    log: DataFrame
    pending: dict[int, list[DataFrame]] = field(default_factory=dict)
    folder: str = ""

    def _add(self, worker: int, deltas: DataFrame) -> None:
        if worker not in self.group.clocks:
            raise KeyError(f"no worker {worker}")
        clock = self.group.clocks[worker]
        rows = deltas.select("row_id", "col_id", "delta", F.lit(worker).alias("worker"), F.lit(clock).alias("clock"))
        self.pending.setdefault(worker, []).append(rows)

    def inc(self, worker: int, df: DataFrame, row, col, delta) -> None:
        self._add(worker, D.inc(df, row, col, delta))

    def batch_inc(self, worker: int, df: DataFrame, row, cols, deltas) -> None:
        self._add(worker, D.batch_inc(df, row, cols, deltas))

    def dense_batch_inc(self, worker: int, df: DataFrame, row, values, first=0) -> None:
        self._add(worker, D.dense_batch_inc(df, row, values, first))

    def _unsent(self, worker: int | None = None) -> DataFrame | None:
        out = None
        for w, parts in self.pending.items():
            if worker is None or w == worker:
                for p in parts:
                    out = p if out is None else out.unionByName(p)
        return out

    def flush(self, worker: int) -> None:
        """Merge what a worker has collected into its increments, one per cell, before it is shipped."""
        if (rows := self._unsent(worker)) is not None:
            merged = rows.groupBy("row_id", "col_id", "worker", "clock").agg(F.sum("delta").alias("delta")).select("row_id", "col_id", "delta", "worker", "clock")
            self.pending[worker] = [merged]

    def _ship(self, worker: int) -> None:
        self.flush(worker)
        if parts := self.pending.pop(worker, None):
            # Only the new slice is written; what was shipped before stays as it is.
            spark = self.group.spark
            parts[0].write.mode("append").parquet(self.folder)
            self.log = spark.read.schema(LOG).parquet(self.folder)

    def read(self, worker: int) -> DataFrame:
        """The cells a worker is sure to see at its clock: others' within the staleness, and all its own, also unsent."""
        clock = self.group.clocks[worker]
        log = self.log
        if (own := self._unsent(worker)) is not None:
            log = log.unionByName(own)
        seen = log.where(C.visible(clock, self.spec.staleness, worker))
        if self.spec.row_kind == "multiplicative":
            return D.merge_product(seen)
        cells = D.merge(seen)
        return D.dense_cells(cells, self.spec.capacity) if self.spec.row_kind == "dense" else D.sparse_rows(cells)

    def get(self, worker: int, row: int) -> DataFrame:
        """One row as the worker sees it."""
        return D.row_of(self.read(worker), row)

    def prefetch(self, worker: int) -> DataFrame:
        """The worker's view, kept in memory and on disk for repeated reads."""
        return self.read(worker).persist()

    def snapshot(self, folder: str) -> int:
        """Write the state all workers have passed; returns its clock."""
        clock = min(self.group.clocks.values(), default=0)
        snapshots.save(C.snapshot_at(self.log, clock), folder, self.table_id, clock)
        return clock


class TableGroup:
    """Tables of a session, their workers and their clock.

    A worker's increments belong to its clock; they join the log when it ticks.
    Each tick appends them to the log's folder in the shared folder, so plans
    stay short, nothing depends on one executor, and what a tick writes doesn't
    grow with the log.
    """

    def __init__(self, spark: SparkSession, workers: int):
        self.spark = spark
        self.rows: dict[int, str] = {}
        self.tables: dict[int, Table] = {}
        self.clocks = {w: 0 for w in range(workers)}

    def register_row(self, row_type: int, kind: str) -> None:
        if kind not in ROW_KINDS:
            raise ValueError(f"no kind of row {kind!r}")
        self.rows[row_type] = kind

    def create_table(self, table_id: int, row_type: int, capacity: int = 0, staleness: int = 0) -> bool:
        """False if there is one of that id already."""
        if table_id in self.tables:
            return False
        spec = TableSpec(self.rows[row_type], capacity, staleness)
        self.tables[table_id] = Table(self, table_id, spec, self.spark.createDataFrame([], LOG), folder=f"{run_dir(self.spark)}/table{table_id}-{uuid.uuid4().hex}")
        return True

    def table(self, table_id: int) -> Table:
        """Raises KeyError for an unknown id."""
        return self.tables[table_id]

    @property
    def max_staleness(self) -> int:
        return max((t.spec.staleness for t in self.tables.values()), default=0)

    def clock(self, worker: int) -> int:
        """Ship a worker's increments and tick it; returns the clock all workers have passed."""
        for t in self.tables.values():
            t._ship(worker)
        self.clocks[worker] += 1
        return min(self.clocks.values())

    def global_barrier(self) -> None:
        """Tick every worker once more than the greatest staleness, so that all see everything."""
        for _ in range(self.max_staleness + 1):
            for w in self.clocks:
                self.clock(w)
