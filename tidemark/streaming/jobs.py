"""Streams over landed files. Every job runs to the end of what is there (``availableNow``) and resumes from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import ensure_checkpoint_dir


def workspace(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A table's Parquet files as a stream; new files in the folder are new input."""
    one = f"{folder}/{name}.parquet"
    if _is_folder(spark, one):
        return spark.readStream.schema(schema).parquet(one)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _run(df: DataFrame, place: str, mode: str, each) -> None:  # noqa: ANN001
    df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(each).start().awaitTermination()


def tumbling_counts(stream: DataFrame, at: str, width: str, keys: list[str], place: str) -> DataFrame:
    """(start, keys, n): counts of event-time windows, however late a row comes.

    Counts add up, so every batch writes the counts of its own rows and no state is held; a batch that is run again
    overwrites its own part. Reading sums the parts.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        one = batch.withColumn("__at", F.col(at).cast("timestamp")).groupBy(F.window("__at", width), *keys).agg(F.count("*").alias("n"))
        one.select(F.col("window.start").alias("start"), *keys, "n").write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    _run(stream, place, "append", each)
    return spark.read.parquet(f"{place}/out").groupBy("start", *keys).agg(F.sum("n").alias("n"))


def first_deliveries(stream: DataFrame, at: str, key: str, place: str, tie: str | None = None, within: str = "7 days") -> DataFrame:
    """The first row of each key by event time (then by ``tie``), whatever order rows arrive in; a restart repeats nothing.

    State holds the keys seen within the time of the watermark, which is the latest event time less ``within``. A key that
    falls behind it is closed: written once and held no longer. A row behind the watermark isn't dropped but closed at
    once; reading folds the closed rows and the state again, so a late row that is earlier than the survivor replaces it.
    """
    spark = stream.sparkSession
    whole = F.struct(*stream.columns)
    rank = F.struct(F.col(at).isNull().alias("none"), F.col(at).cast("timestamp").alias("at"), *([F.col(tie).alias("tie")] if tie else []))
    fold = lambda df: df.groupBy("key").agg(F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank"), F.max("seen").alias("seen"))

    def each(batch: DataFrame, number: int) -> None:
        rows = fold(batch.select(F.col(key).alias("key"), whole.alias("row"), rank.alias("rank"), F.col(at).cast("timestamp").alias("seen")))
        before = [n for n in range(number - 1, -1, -1) if _exists(spark, f"{place}/v{n}/_SUCCESS")]
        if before:
            rows = fold(spark.read.parquet(f"{place}/v{before[0]}").unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{place}/folded")
        rows = spark.read.parquet(f"{place}/folded")
        mark = rows.agg((F.max("seen") - F.expr(f"INTERVAL {within}")).alias("mark"))
        live = F.coalesce(F.col("seen") >= F.col("mark"), F.lit(False))
        rows.crossJoin(mark).where(~live).drop("mark").write.mode("overwrite").parquet(f"{place}/closed/batch={number}")
        rows.crossJoin(mark).where(live).drop("mark").write.mode("overwrite").parquet(f"{place}/v{number}")
        spark.createDataFrame([(number,)], "n int").write.mode("overwrite").parquet(f"{place}/last")

    _run(stream, place, "append", each)
    last = spark.read.parquet(f"{place}/last").first()["n"]
    return fold(spark.read.parquet(f"{place}/closed").drop("batch").unionByName(spark.read.parquet(f"{place}/v{last}"))).select("row.*")


def version_stream(stream: DataFrame, keys: list[str], at: str, tie: str, digest: Column, place: str) -> DataFrame:
    """(keys, digest, first_at, last_at): contents by key; a batch adds new ones and touches known ones.

    A batch writes what it saw of each key's contents and nothing else; a batch that is run again overwrites its own part.
    Reading folds the parts, so that no batch reads or rewrites what is there.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("digest", digest).groupBy(*keys, "digest").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at")).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    _run(stream, place, "append", each)
    return spark.read.parquet(f"{place}/out").groupBy(*keys, "digest").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ranked_states(stream: DataFrame, key: str, state: str, rank: Column, at: str, tie: str, place: str) -> DataFrame:
    """(key, state, n): a state moves on only to an equal or higher rank, whatever order rows arrive in; custom state."""
    spark = stream.sparkSession
    slim = stream.select(F.col(key).alias("key"), F.col(state).alias("state"), rank.cast("int").alias("rank"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).cast("bigint").alias("tie"))

    def fold(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        best, n = None, 0
        if held.exists:
            rank_, at_, tie_, state_, n = held.get
            best = (rank_, at_, tie_, state_)
        for p in parts:
            n += len(p)
            top = p.sort_values(["rank", "at", "tie"]).iloc[-1]
            row = (int(top["rank"]), int(top["at"]), int(top["tie"]), top["state"])
            best = row if best is None or row[:3] > best[:3] else best
        held.update((*best, n))
        yield pd.DataFrame({"key": [k[0]], "state": [best[3]], "n": [n]})

    kind = slim.schema["key"].dataType.simpleString()
    f = slim.groupBy("key").applyInPandasWithState(fold, f"key {kind}, state string, n bigint", "rank int, at bigint, tie bigint, state string, n bigint", "update", GroupStateTimeout.NoTimeout)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    _run(f, place, "update", each)
    got = spark.read.parquet(f"{place}/out")
    return got.groupBy("key").agg(F.max_by("state", "batch").alias("state"), F.max("n").alias("n")).withColumnRenamed("key", key)


def attach_late(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str) -> DataFrame:
    """Stream-stream join: notices meet deliveries of one key no farther apart than ``within``; both sides' state is bounded."""
    a = left.withColumn("__l", F.col(left_at).cast("timestamp")).withWatermark("__l", within).alias("l")
    b = right.withColumn("__r", F.col(right_at).cast("timestamp")).withWatermark("__r", within).alias("r")
    near = (F.col("r.__r") >= F.col("l.__l") - F.expr(f"INTERVAL {within}")) & (F.col("r.__r") <= F.col("l.__l") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"l.{key}") == F.col(f"r.{key}")) & near, "inner")


def attached(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, place: str) -> DataFrame:
    """(key, the columns of both): ``attach_late`` run to the end of what has landed; a restart repeats no pair."""
    spark = left.sparkSession
    met = attach_late(left, right, key, left_at, right_at, within).select(F.col(f"l.{key}").alias(key), *[f"l.{c}" for c in left.columns if c != key], *[f"r.{c}" for c in right.columns if c != key])

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    _run(met, place, "append", each)
    return spark.read.schema(met.schema).parquet(f"{place}/out/*")
