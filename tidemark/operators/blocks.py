"""Hot groups cut into blocks of their own order, so that no task has to sort all of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group with more rows than this is cut.
HOT_ROWS = 200_000
#: Blocks that a hot group is cut into, at most.
BLOCKS = 256


def cut_hot(rows: DataFrame, keys: list[str], at: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``block``, keys of hot groups): blocks follow ``at`` (a number); rows of one time share a block.

    Groups of ``hot_rows`` or fewer have the one block 0. Quantiles are sketched in an aggregation that combines before
    the shuffle; a block's size is about a 256th of its group unless many rows share one time.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(*keys)
    cuts = rows.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(at, [i / BLOCKS for i in range(1, BLOCKS)], 2000).alias("__cuts"))
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(at))), F.lit(0))
    return rows.join(cuts, keys, "left").withColumn("block", F.greatest(below, F.lit(0))).drop("__cuts"), hot


def carried(blocked: DataFrame, hot: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, block, before): for each block of a hot group but its first, the value that the block before it ends with.

    One row a block is made; ``value`` and ``before`` are structs, so that a null value is told from none.
    """
    ends = blocked.join(hot, keys, "left_semi").groupBy(*keys, "block").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    return ends.withColumn("before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("block"))).select(*keys, "block", "before")


def stamp(at: str):  # noqa: ANN201
    """A time as a number to cut by; null times come first."""
    return F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62)))


def with_previous(df: DataFrame, keys: list[str], at: str, tie: str, value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the value of the row before each row of its group, by time and tie; null for the first."""
    blocked, hot = cut_hot(df.withColumn("__at", stamp(at)).withColumn("__v", F.struct(F.col(value).alias("v"))), keys, "__at", hot_rows)
    w = Window.partitionBy(*keys, "block").orderBy(at, tie)
    across = carried(blocked, hot, keys, "__v", ["__at", tie])
    got = blocked.withColumn("__p", F.lag("__v").over(w)).join(across, [*keys, "block"], "left")
    return got.withColumn(name, F.coalesce("__p", "before")["v"]).select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], by: str, ties: list, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the number, from 1, of each row in its group, by a number and ties; blocks of a hot group count apart first."""
    blocked, hot = cut_hot(df.withColumn("__at", F.col(by).cast("bigint")), keys, "__at", hot_rows)
    counts = blocked.join(hot, keys, "left_semi").groupBy(*keys, "block").agg(F.count("*").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).select(*keys, "block", "__o")
    own = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(by, *ties))
    return blocked.withColumn("__k", own).join(offsets, [*keys, "block"], "left").withColumn(name, (F.col("__k") + F.coalesce("__o", F.lit(0))).cast("int")).select(*df.columns, name)
