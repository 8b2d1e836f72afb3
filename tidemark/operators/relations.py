"""Latest rows, ranks, set reconciliation, related rows and other relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order`` (nulls first): an aggregation that combines before the shuffle.

    No window: a hot key is reduced to one row in every map task. Rows equal in ``order`` count as one; give a unique
    last column.
    """
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return got.select(*keys, *[F.col("__x")[c].alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).withColumnRenamed("__r", "rank")


def first_filled(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row a key: each field's first non-empty value in ``order``; rows of one identity fill each other's gaps."""
    rank = F.struct(*order)
    some = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    return df.groupBy(*keys).agg(*[F.min_by(f, F.when(some(f), rank)).alias(f) for f in fields])


def reconcile(stored: DataFrame, referenced: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """(key, state): orphan (stored, not referenced), missing (referenced, not stored), protected or kept, by set algebra."""
    side = lambda df, n: df.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct().withColumn(n, F.lit(1))
    both = side(stored, "__s").join(side(referenced, "__r"), "__k", "full").join(side(protected, "__p"), "__k", "left")
    state = F.when(F.col("__s").isNull(), "missing").when(F.col("__p").isNotNull(), "protected").when(F.col("__r").isNull(), "orphan").otherwise("kept")
    return both.select(F.col("__k").alias(key), state.alias("state"))


def related(df: DataFrame, key: str, entities: str, cluster: str, order: list[Column], k: int = 4) -> DataFrame:
    """(key, related, rank): the first ``k`` other rows, in list order, that share an entity or the cluster.

    Only the first k + 1 rows of a link can be among anyone's first k, so that a hot entity adds k + 1 rows and never
    its square.
    """
    ranked = df.select(F.col(key).alias("k"), F.coalesce(F.col(entities), F.array().cast("array<string>")).alias("e"), F.col(cluster).alias("c"), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)]).alias("o"))
    links = F.concat(F.transform(F.array_distinct("e"), lambda e: F.concat(F.lit("e:"), e)), F.when(F.col("c").isNotNull(), F.array(F.concat(F.lit("c:"), F.col("c")))).otherwise(F.array().cast("array<string>")))
    edges = ranked.select("k", "o", F.explode(links).alias("link"))
    heads = edges.withColumn("r", F.row_number().over(Window.partitionBy("link").orderBy("o"))).where(F.col("r") <= k + 1).select("link", F.col("k").alias("related"), F.col("o").alias("ro"))
    met = edges.join(heads, "link").where("k <> related").groupBy("k", "related").agg(F.min("ro").alias("ro"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("ro"))).where(F.col("rank") <= k).select(F.col("k").alias(key), "related", "rank")


def facet_counts(df: DataFrame, scalars: list[str], arrays: list[str]) -> DataFrame:
    """(facet, value, n): counts of every value of the scalar and array columns, in one pass and one shuffle."""
    one = lambda name, v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))
    singles = F.array(*[one(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in scalars])
    named = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: one(c, v))
    many = [named(c) for c in arrays]
    return df.select(F.explode(F.concat(singles, *many)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def rotate(df: DataFrame, order: list[Column], fresh: int, window: int, offset: int) -> DataFrame:
    """The ``fresh`` first rows and, of the rest, a window of rows that moves on by ``offset`` and wraps around.

    The rank over the whole list is the feature: the list is one page's links.
    """
    ranked = df.withColumn("__p", F.row_number().over(Window.orderBy(*order)) - 1)
    pool = ranked.agg((F.count("*") - fresh).alias("__n"))
    placed = ranked.join(F.broadcast(pool))  # one row
    turn = F.pmod(F.col("__p") - fresh - F.lit(offset), F.greatest("__n", F.lit(1)))
    return placed.where((F.col("__p") < fresh) | (turn < window)).drop("__p", "__n")


def stop_at_known(df: DataFrame, group: str, position: str, known: Column) -> DataFrame:
    """Rows of each group before the first one that is already known."""
    stop = df.groupBy(group).agg(F.min(F.when(known, F.col(position))).alias("__stop"))
    return df.join(stop, group).where(F.col("__stop").isNull() | (F.col(position) < F.col("__stop"))).drop("__stop")


def quota(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The rows that a limit per key lets through, in order."""
    return top_per_key(df, keys, order, limit)


def fold_by_rank(df: DataFrame, key: str, state: str, rank: Column, at: str, tie: str) -> DataFrame:
    """(key, state, n): the state that stands after all rows: the highest rank, of equal ranks the latest."""
    return df.groupBy(key).agg(F.max_by(state, F.struct(rank, at, tie)).alias(state), F.count("*").alias("n"))
