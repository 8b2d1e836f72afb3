"""Every time text of a table as one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import utc_micros


def with_source_clock(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` with its source's ``__zone`` and ``__order``; rows without a known source keep nulls there.

    A repeated source id in ``sources`` counts once (its smallest zone and order), so that no row is doubled.
    """
    clock = sources.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("__source")).agg(F.min("time_zone").alias("__zone"), F.min("date_order").alias("__order"))
    return df.join(clock, df["source_id"] == clock["__source"], "left").drop("__source")


def instants(tables: list[tuple[DataFrame, str, str, list[str]]], sources: DataFrame) -> DataFrame:
    """(record_kind, row_key, field_name, utc_micros): one row per value that states a possible instant.

    ``tables``: (rows, kind, key column, time columns); each needs ``source_id`` besides, other columns are not read.
    All values go through one cascade. Null keys, null and unreadable values give no row; repeated rows give one row.
    """
    long = None
    for df, kind, key, fields in tables:
        values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in fields])
        one = df.select(F.lit(kind).alias("record_kind"), F.col(key).alias("row_key"), "source_id", F.explode(values).alias("x")).select("record_kind", "row_key", "source_id", "x.*")
        long = one if long is None else long.unionByName(one)
    timed = with_source_clock(long.where("v is not null and row_key is not null"), sources)
    out = timed.select("record_kind", "row_key", "field_name", utc_micros(F.col("v"), F.col("__zone"), F.col("__order")).alias("utc_micros"))
    return out.where(F.col("utc_micros").isNotNull()).groupBy("record_kind", "row_key", "field_name").agg(F.min("utc_micros").alias("utc_micros"))
