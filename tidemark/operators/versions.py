"""Versions of records: replay of deliveries, change kinds, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import text_changed
from tidemark.operators.blocks import HOT_ROWS, carried, cut_hot


def replay(df: DataFrame, keys: list[str], at: str, tie: str, digest: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Deliveries in time order, each with the hash before it: those that change it get a version number.

    Returns the keys, at, tie, digest, previous digest and revision_no (1 for the first). Rows carry hashes, no texts; a
    hot key is cut into blocks of its timeline, and one row a block carries the hash and the count across. Null times
    come first and share a block.
    """
    stamp = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62)))
    slim = df.select(*keys, at, tie, digest.alias("digest"), F.struct(digest.alias("d")).alias("__state"), stamp.alias("__at"))
    blocked, hot = cut_hot(slim, keys, "__at", hot_rows)
    w = Window.partitionBy(*keys, "block").orderBy(at, tie)
    across = carried(blocked, hot, keys, "__state", ["__at", tie])
    seen = blocked.withColumn("__prev", F.lag("__state").over(w)).join(across, [*keys, "block"], "left").withColumn("__prev", F.coalesce("__prev", "before"))
    first = F.col("__prev").isNull()
    marked = seen.withColumn("__c", F.when(first | ~F.col("__prev.d").eqNullSafe(F.col("digest")), 1).otherwise(0)).withColumn("__k", F.sum("__c").over(w))
    counts = marked.join(hot, keys, "left_semi").groupBy(*keys, "block").agg(F.sum("__c").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).select(*keys, "block", "__o")
    out = marked.where("__c = 1").join(offsets, [*keys, "block"], "left")
    return out.select(*keys, at, tie, "digest", F.col("__prev.d").alias("previous"), (F.col("__k") + F.coalesce("__o", F.lit(0))).cast("int").alias("revision_no"))


def change_kind(is_first: Column, published: Column, seen: Column, material: Column) -> Column:
    """new, late (published more than 48 hours before it was seen), material or minor."""
    late = published < seen - F.expr("INTERVAL 48 HOURS")
    return F.when(is_first, F.when(F.coalesce(late, F.lit(False)), "late").otherwise("new")).when(material, "material").otherwise("minor")


def material_change(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Whether a title, summary, version or code address changed in substance."""
    differs = lambda n: ~old[n].eqNullSafe(new[n])
    return differs("title") | differs("version") | differs("code_url") | text_changed(old["summary"], new["summary"])


def retention(versions: DataFrame, current: DataFrame, referenced: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Each version with its reasons to stay: current, latest history, referenced, recent; none makes it a candidate.

    ``versions``: id, item_id, fetched_at and payload; ``current``: item_id, id; ``referenced``: id.
    """
    cur = current.select(F.col("item_id").alias("__ci"), F.col("id").alias("__cv")).distinct()
    refs = referenced.select(F.col("id").alias("__rv")).where("__rv is not null").distinct()
    tagged = versions.join(cur, (versions["item_id"] == F.col("__ci")) & (versions["id"] == F.col("__cv")), "left").join(refs, versions["id"] == F.col("__rv"), "left")
    tagged = tagged.withColumn("is_current", F.col("__cv").isNotNull()).withColumn("is_referenced", F.col("__rv").isNotNull()).drop("__ci", "__cv", "__rv")
    # the latest predecessor by aggregation, not by a sort of all versions
    prev = tagged.where(~F.col("is_current")).groupBy("item_id").agg(F.max_by("id", F.struct("fetched_at", "id")).alias("__pv"))
    out = tagged.join(prev, "item_id", "left").withColumn("is_latest_history", F.coalesce(F.col("id") == F.col("__pv"), F.lit(False))).drop("__pv")
    age = F.datediff(now, F.col("fetched_at"))
    out = out.withColumn("is_recent", F.col("fetched_at") >= now - F.expr(f"INTERVAL {days} DAYS")).withColumn("age_days", age)
    return out.withColumn("is_candidate", ~(F.col("is_current") | F.col("is_referenced") | F.col("is_latest_history") | F.col("is_recent")))
