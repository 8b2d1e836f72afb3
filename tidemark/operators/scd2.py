"""Type-two dimension of changing attributes: a merge of deliveries against current versions.

The dimension holds, for each entity, every version it was told of, with the hash of its attributes and, where the version
opened a period, the period. A batch is merged in: of an entity whose new versions are all unknown and later than what it
holds, the hashes are compared with its current version alone, the changed one is closed and new open versions come in. An
entity with a late version, or with one that replaces a version it holds, is gone through again from its own versions. No
other entity is touched. An initial load is a merge into an empty dimension.

A hot entity is cut into blocks of its own timeline, so that no task has to sort all of it: the windows run within blocks,
and one summary row per block carries the state across.

Defined results: rows with a null entity take no part; a version with a null time has no place in a timeline, but replaces
earlier deliveries of itself; a null state closes the open version and opens none; repeated rows count once; an empty
input gives an empty history. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators.blocks import carried, cut_hot
from tidemark.session import cut

#: An entity with more rows than this is cut into blocks.
HOT_ROWS = blocks.HOT_ROWS
#: Loads that ``history`` merges one after the other.
LOADS = 2
#: Columns of the dimension: ``rank`` is when a version was received and its tie, ``place`` tells whether it counts in its entity's timeline.
DIMENSION = ("entity", "version", "at", "hash", "rank", "place", "valid_from", "valid_to")


def state_hash(columns: list[Column]) -> Column:
    """SHA-256 of the attributes; nulls are kept apart from empty values, and the names of the parts count."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _timeline(rows: DataFrame) -> DataFrame:
    """``rows`` (entity, version, at, hash, rank; one a time) with valid_from and valid_to of those that open a period."""
    order = Window.partitionBy("entity", "block").orderBy("at")
    blocked, hot = cut_hot(rows.withColumn("state", F.struct("hash")), ["entity"], "at", HOT_ROWS)
    inner = blocked.withColumn("prev", F.lag("state").over(order))
    # the state at a block's end reaches the first row of the next block
    across = carried(blocked, hot, ["entity"], "state", ["at"])
    joined = inner.join(across, ["entity", "block"], "left")
    # the first row of an entity with a null state changes nothing: it equals "no version before"
    marks = joined.withColumn("mark", ~F.coalesce("prev", "before")["hash"].eqNullSafe(F.col("hash")))
    within = marks.withColumn("next", F.min(F.when(F.col("mark"), F.col("at"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    starts = marks.where("mark").join(hot, "entity", "left_semi").groupBy("entity", "block").agg(F.min("at").alias("first"))
    later = starts.withColumn("after", F.lead("first").over(Window.partitionBy("entity").orderBy("block"))).select("entity", "block", "after")
    # a block without a mark has no row here, but no row of it needs one
    opens = F.col("mark") & F.col("hash").isNotNull()
    out = within.join(later, ["entity", "block"], "left")
    return out.select("entity", "version", "at", "hash", "rank", F.lit(True).alias("place"), F.when(opens, F.col("at")).alias("valid_from"), F.when(opens, F.coalesce("next", "after")).alias("valid_to"))


def _settled(rows: DataFrame) -> DataFrame:
    """The dimension of ``rows`` (entity, version, at, hash, rank) from the ground up: one row a version, the last received."""
    last = rows.groupBy("entity", "version").agg(F.max_by(F.struct("at", "hash", "rank"), "rank").alias("x")).select("entity", "version", "x.*")
    # of versions of one time the highest has the place; the others, and those without a time, are only kept
    top = last.where(F.col("at").isNotNull()).groupBy("entity", "at").agg(F.max("version").alias("top"), F.lit(True).alias("timed"))
    told = last.join(top, ["entity", "at"], "left").withColumn("place", F.coalesce("timed", F.lit(False)) & F.col("version").eqNullSafe(F.col("top")))
    told = cut(told.drop("top", "timed"))  # the timeline reads it several times
    rest = told.where(~F.col("place")).select("entity", "version", "at", "hash", "rank", "place", F.lit(None).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    return _timeline(told.where("place").select("entity", "version", "at", "hash", "rank")).unionByName(rest)


def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The dimension ``current`` (None: an empty one) after a batch of versions (entity, version, at, hash, rank).

    ``current`` is read several times: give a written table, as ``history`` does between its loads.
    """
    new = batch.where(F.col("entity").isNotNull()).select("entity", "version", "at", "hash", "rank")
    if current is None:
        return _settled(new)
    new = new.groupBy("entity", "version").agg(F.max_by(F.struct("at", "hash", "rank"), "rank").alias("x")).select("entity", "version", "x.*")
    new = cut(new)
    newest = current.groupBy("entity").agg(F.max("at").alias("newest"))
    held = current.select(F.col("entity").alias("__e"), F.col("version").alias("__v"), F.lit(True).alias("held"))
    # late: not after all that its entity holds; replacing: a version that its entity holds
    against = new.join(newest, "entity", "left").join(held, (F.col("entity") == F.col("__e")) & F.col("version").eqNullSafe(F.col("__v")), "left")
    touched = against.groupBy("entity").agg(F.max(F.coalesce(F.col("held"), F.lit(False)) | F.coalesce(F.col("at") <= F.col("newest"), F.lit(False))).alias("again"))
    old = current.join(touched, "entity", "left").withColumn("open", F.col("valid_from").isNotNull() & F.col("valid_to").isNull())
    compared = F.coalesce("again", F.lit(False)) | (F.col("again").isNotNull() & F.col("open"))
    # an entity that only grows is compared by its open version, the others by all their versions
    return old.where(~compared).select(*DIMENSION).unionByName(_settled(old.where(compared).select("entity", "version", "at", "hash", "rank").unionByName(new)))


def history(updates: DataFrame, entity: str, version: str, at: Column, state: Column, received: str, tie: str, loads: int = LOADS) -> DataFrame:
    """(entity, version, hash, valid_from, valid_to): one row per period in which an entity kept one state.

    The updates are merged in ``loads`` batches by the time they were received, so that later batches hold late and
    replacing versions as they came. ``at`` and the results are microseconds since 1970 UTC; ``valid_to`` is null for the
    open version. Of rows with one (entity, version) the one received last counts (then the greatest ``tie``, nulls
    lowest); of versions with one time the highest. ``state`` is the hash of the attributes, null for no state.
    """
    rows = updates.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.col(version).alias("version"), at.alias("at"), state.alias("hash"), F.struct(F.col(received), F.col(tie)).alias("rank"), blocks.stamp(received).alias("load"))
    ends = rows.agg(F.percentile_approx("load", [i / loads for i in range(1, loads)], 1000)).first()[0] if loads > 1 else []
    dimension = None
    for after, until in zip([None, *(ends or [])], [*(ends or []), None]):
        batch = rows if after is None else rows.where(F.col("load") > after)
        batch = batch if until is None else batch.where(F.col("load") <= until)
        dimension = merge(dimension, batch)
        dimension = dimension if until is None else cut(dimension)
    return dimension.where(F.col("valid_from").isNotNull()).select("entity", "version", "hash", "valid_from", "valid_to")
