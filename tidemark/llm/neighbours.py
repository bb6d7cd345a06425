"""The k most similar vectors of each query vector, from graphs over shards of space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.clusters import SplitTree
from tidemark.llm.graph import nearest_in_shard
from tidemark.llm.vectors import from_binary
from tidemark.runtime import staged

SHARD_ROWS, PROBED, SAMPLE_ROWS, QUERY_ROWS = 8192, 32, 65_536, 16_384


def shard_centres(vectors: DataFrame, rows: int, shard_rows: int, sample_rows: int, seed: int) -> np.ndarray:
    """Centres of the shards: leaves of a split tree over a sample of about ``sample_rows`` vectors.

    Never more than one for every 48 vectors of the sample, so their number is bounded.
    """
    rate = min(1.0, sample_rows / max(rows, 1))
    sample = from_binary(vectors.where(F.expr(f"pmod(xxhash64(vec, {seed}), 1000003) < {rate} * 1000003")).select("vec").toArrow().column("vec"))
    if not len(sample):
        return np.zeros((1, 64), np.float32)
    tree = SplitTree(sample, max(48, int(0.75 * len(sample) * shard_rows / max(rows, 1))), 2.0, seed)
    leaf = tree.route(sample)
    sums = np.zeros((tree.leaves, sample.shape[1]))
    np.add.at(sums, leaf, sample)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (sums / np.where(length > 0, length, 1)).astype(np.float32)[length[:, 0] > 0]


def _nearest_centres(df: DataFrame, columns: str, centres: np.ndarray, most: int) -> DataFrame:
    """The rows, each once for every of its ``most`` nearest shards; ``vec`` comes last in ``columns``."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            dots = from_binary(b.column(len(names) - 1)) @ centres.T
            m = min(most, len(centres))
            near = np.argpartition(-dots, m - 1, axis=1)[:, :m].ravel() if b.num_rows else np.zeros(0, np.int64)
            rows = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *[c.take(rows) for c in b.columns]], ["shard", *names])

    return df.select(*names).mapInArrow(run, f"shard int, {columns}")


def nearest(vectors: DataFrame, queries: DataFrame, shard_rows: int = SHARD_ROWS, probed: int = PROBED, sample_rows: int = SAMPLE_ROWS, query_rows: int = QUERY_ROWS, query_beam: int = 160, degree: int = 20, beam: int = 40, alpha: float = 1.05, seed: int = 5) -> DataFrame:
    """``query_id, id, similarity, place``: each query's k most similar other vectors.

    ``vectors(id, vec)`` and ``queries(query_id, vec, k)`` hold packed unit
    vectors (:func:`tidemark.llm.vectors.unit_vectors`). Space is parted into
    shards around centres that a sample of about ``sample_rows`` vectors gives;
    every vector lies in the shard of its nearest centre, and of equal vectors
    only as many as a query can ask for, those with the smallest ids. A shard
    that has become larger than twice ``shard_rows`` is cut into pieces by a
    hash. Each piece is a task: it builds a robust-pruned graph over its
    vectors and runs a beam search for the queries that ask it; only the k best
    of a piece leave it. A query asks all pieces of its ``probed`` nearest
    shards, in blocks of ``query_rows``, each a task of its own. So a query's
    work depends on ``probed`` and not on the size of the table, and a task's
    on ``shard_rows`` and ``query_rows``.

    With up to ``probed`` shards all are asked. Recall against brute force is
    measured in the tests and in the README; more ``probed`` shards raise it,
    above all for queries with no vector near them. Similarities are exact dot
    products; ties fall to the smaller id. A query is not its own neighbour;
    with fewer than k others it gets them all. Repeated ids count once. Queries
    with a null or non-positive k get nothing. Empty tables give no rows.
    """
    asked = queries.where("k > 0").select(F.col("query_id").alias("id"), F.col("k").cast("int").alias("k"), "vec")
    most = asked.agg(F.coalesce(F.max("k"), F.lit(1))).first()[0]
    # Spark limits the rank before the shuffle too, so any number of copies comes down to a few.
    copies = vectors.select("id", "vec").distinct().withColumn("copy", F.row_number().over(W.partitionBy("vec").orderBy("id")))
    kept = copies.where(F.col("copy") <= most + 1).select("id", "vec")
    rows = vectors.count()
    centres = shard_centres(vectors, rows, shard_rows, sample_rows, seed)
    placed = staged(_nearest_centres(kept, "id bigint, vec binary", centres, 1), "knn-shards")
    wanted = staged(_nearest_centres(asked, "id bigint, k int, vec binary", centres, probed), "knn-queries")
    # One row a shard, of which there is a bounded number.
    pieces = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * shard_rows)).cast("int").alias("pieces"))
    blocks = wanted.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_rows)).cast("int").alias("blocks"))
    cuts = F.broadcast(pieces.join(blocks, "shard"))
    by_hash = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    one_each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(cuts, "shard").withColumn("piece", by_hash("pieces")).withColumn("block", one_each("blocks")).select("shard", "piece", "block", "id", F.lit(None).cast("int").alias("k"), "vec")
    right = wanted.join(cuts, "shard").withColumn("block", by_hash("blocks")).withColumn("piece", one_each("pieces")).select("shard", "piece", "block", "id", "k", "vec")
    options = {"degree": degree, "slack": degree, "beam": beam, "alpha": alpha}

    def run(group: pa.Table) -> pa.Table:
        ks = group.column("k").to_numpy(zero_copy_only=False)
        is_query = ~np.isnan(ks.astype(float))
        ids = group.column("id").to_numpy()
        x = from_binary(group.column("vec"))
        own, asks = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        own = own[np.argsort(ids[own], kind="stable")]
        row, got, sim = nearest_in_shard(x[own], ids[own], x[asks], ids[asks], ks[asks].astype(np.int64), query_beam, **options)
        return pa.table({"query_id": pa.array(ids[asks][row], pa.int64()), "k": pa.array(ks[asks][row].astype(np.int32), pa.int32()), "id": pa.array(got, pa.int64()), "similarity": pa.array(sim, pa.float32())})

    found = left.unionByName(right).groupBy("shard", "piece", "block").applyInArrow(run, "query_id bigint, k int, id bigint, similarity float")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).where("place <= k").select("query_id", "id", "similarity", "place")
