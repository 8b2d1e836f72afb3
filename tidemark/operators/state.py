"""State tables: keyed upserts, insert-or-ignore, carried cursors, failure streaks, injected enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after a batch: of the rows of a key, the batch's last by ``order``, else what was there.

    One shuffle of both sides; repeated keys within the batch count once.
    """
    rest = [c for c in current.columns if c not in keys]
    side = lambda df, n: df.select(*keys, F.struct(F.lit(n).alias("__n"), *[F.col(c).alias(f"__{c}") for c in order]).alias("__o"), F.struct(*rest).alias("__v"))
    got = side(current, 0).unionByName(side(batch, 1)).groupBy(*keys).agg(F.max_by("__v", "__o").alias("__v"))
    return got.select(*keys, *[F.col("__v")[c].alias(c) for c in rest])


def insert_or_ignore(current: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a batch whose keys are new, the first of each by ``order`` (L2)."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*keys, *[F.col("__v")[c].alias(c) for c in rest])
    return first.join(current.select(*keys).distinct(), keys, "left_anti")


def carry_forward(current: DataFrame, batch: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Cursor rows after a poll: new values where there are any, else the old ones, else the defaults."""
    fields = [c for c in current.columns if c not in keys]
    old = current.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in fields])
    new = batch.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fields])
    value = lambda c: F.coalesce(f"__new_{c}", f"__old_{c}", defaults[c]) if c in defaults else F.coalesce(f"__new_{c}", f"__old_{c}")
    return old.join(new, keys, "full").select(*keys, *[value(c).alias(c) for c in fields])


def failure_streaks(runs: DataFrame, key: str, at: str, tie: str, failed: Column) -> DataFrame:
    """(key, failures, last_success): failures since the last success, by two combinable aggregations, no window."""
    x = runs.select(F.col(key).alias("k"), F.struct(F.col(at), F.col(tie)).alias("o"), F.col(at).alias("at"), failed.alias("failed"))
    ok = x.groupBy("k").agg(F.max(F.when(~F.col("failed"), F.col("o"))).alias("ok"))
    counted = x.join(ok, "k").groupBy("k").agg(F.count_if(F.col("failed") & (F.col("ok").isNull() | (F.col("o") > F.col("ok")))).alias("failures"), F.max(F.when(~F.col("failed"), F.col("at"))).alias("last_success"))
    return counted.select(F.col("k").alias(key), "failures", "last_success")


def due(sources: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Sources to poll now: enabled, not waiting for a retry, and due (C1). Needs enabled, retry_at, next_due_at."""
    ready = F.col("enabled") & (F.col("retry_at").isNull() | (F.col("retry_at") <= now))
    return sources.where(ready if force else ready & (F.col("next_due_at").isNull() | (F.col("next_due_at") <= now)))


class ProviderError(ValueError):
    """What a provider raises for a batch it can't answer."""


def enrich(df: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame] | None, schema: str, errors: tuple[type[Exception], ...] = (ValueError, TimeoutError, ConnectionError), status: str | None = None, fallback: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Rows through an injected provider, batch by batch (K2 to K4); without one, rows pass as they are.

    A provider that raises one of ``errors`` on a batch hands it to ``fallback``; without one the batch stays as it was and
    the columns it would have added are null. Any other fault, a missing column among them, fails the job. ``status`` names
    a column that tells of each row who answered: provider, fallback or none (K3).
    """
    if provider is None:
        return df.withColumn(status, F.lit("none")) if status else df
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def answered(b: pd.DataFrame) -> tuple[pd.DataFrame, str]:
        try:
            return provider(b), "provider"
        except errors:
            return (fallback(b), "fallback") if fallback else (b.reindex(columns=names), "none")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got, who = answered(b)
            yield got[names].assign(**{status: who}) if status else got[names]

    return df.mapInPandas(run, f"{schema}, {status} string" if status else schema)
