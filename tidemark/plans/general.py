"""Queries of the general training-data problems (3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.io import table
from tidemark.operators.instants import instants
from tidemark.operators.scd2 import history, state_hash


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = [(table(spark, folder, "collected_items"), "item", "record_id", ["published_at", "updated_at"]), (table(spark, folder, "radar_events"), "event", "event_id", ["source_time"])]
    return instants(tables, table(spark, folder, "source_specs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("snapshot")
    attributes = [s[n].alias(n) for n in ("title_zh", "verification_status", "score", "primary_url")]
    state = F.when(s.isNotNull(), state_hash([*attributes, F.sort_array(s["topics"]).alias("topics")]))
    got = history(table(spark, folder, "event_revisions"), "event_id", "revision_no", F.unix_micros(F.col("created_at").cast("timestamp")), state, "received_at", "id")
    return got.select(
        F.col("entity").alias("event_id"), F.col("version").alias("revision_no"), F.col("valid_from").alias("valid_from_us"), F.coalesce("valid_to", F.lit(-1)).cast("bigint").alias("valid_to_us")
    )


P5_SQL = """
WITH last AS (
  SELECT event_id, revision_no, snapshot, epoch_us(created_at) AS ts FROM event_revisions WHERE event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id, revision_no ORDER BY received_at DESC NULLS LAST, id DESC NULLS LAST) = 1),
one AS (
  SELECT * FROM last WHERE ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id, ts ORDER BY revision_no DESC NULLS LAST) = 1),
st AS (
  SELECT event_id, revision_no, ts, CASE WHEN snapshot IS NULL THEN NULL ELSE
    CAST({'a': snapshot.title_zh, 'b': snapshot.verification_status, 'c': snapshot.score, 'd': list_sort(snapshot.topics), 'e': snapshot.primary_url} AS VARCHAR) END AS s FROM one),
mk AS (
  SELECT *, lag(s) OVER (PARTITION BY event_id ORDER BY ts) AS p FROM st QUALIFY s IS DISTINCT FROM lag(s) OVER (PARTITION BY event_id ORDER BY ts)),
nx AS (SELECT *, lead(ts) OVER (PARTITION BY event_id ORDER BY ts) AS n FROM mk)
SELECT event_id, revision_no, ts AS valid_from_us, CAST(coalesce(n, -1) AS BIGINT) AS valid_to_us FROM nx WHERE s IS NOT NULL
"""

QUERIES = {"p3_found": p3_found, "p5_found": p5_found}
ORACLES = {"p5_found": P5_SQL}
