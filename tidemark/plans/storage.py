"""Queries on stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.consolidate import consolidate_records, read_consolidated
from tidemark.runtime import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    manifest, out = consolidate_records(table(spark, root, "shard_record"), table(spark, root, "shard_file"))
    return read_consolidated(manifest, out).select("file_id", "rec_no")


def p4_parts(spark: SparkSession, root: str) -> DataFrame:
    manifest, _ = consolidate_records(table(spark, root, "shard_record"), table(spark, root, "shard_file"))
    return manifest.groupBy("part").agg(F.count(F.lit(1)).alias("frames"), F.sum("n_records").alias("n_records"), F.sum("length").alias("n_bytes"))


def p4_totals(spark: SparkSession, root: str) -> DataFrame:
    """Records in the parts of each database, by the manifest."""
    manifest, _ = consolidate_records(table(spark, root, "shard_record"), table(spark, root, "shard_file"))
    return manifest.groupBy(F.regexp_replace("part", "-[0-9]+[.]zst$", "").alias("db_name")).agg(F.sum("n_records").alias("n_records"))


QUERIES = {"p4_found": p4_found, "p4_parts": p4_parts, "p4_totals": p4_totals}

ORACLE = {
    "p4_found": """
        WITH f AS (SELECT file_id, min(db_name) AS db_name FROM shard_file GROUP BY file_id),
             r AS (SELECT s.file_id, s.rec_no,
                          row_number() OVER (PARTITION BY f.db_name, s.datum_key, s.data ORDER BY s.file_id, s.rec_no) AS n
                   FROM shard_record s LEFT JOIN f USING (file_id))
        SELECT file_id, rec_no FROM r WHERE n = 1
    """,
    "p4_totals": """
        WITH f AS (SELECT file_id, min(db_name) AS db_name FROM shard_file GROUP BY file_id),
             r AS (SELECT DISTINCT f.db_name, s.datum_key, s.data FROM shard_record s LEFT JOIN f USING (file_id))
        SELECT coalesce(db_name, '__null') AS db_name, count(*) AS n_records FROM r GROUP BY 1
    """,
}
