"""Pairs within groups, without gathering any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one variant that a join task takes; the ids of a variant with more are spread over several.
HOT_ROWS = 50_000


def pairs_within(df: DataFrame, group: str, variant: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_a, id_b): pairs of ids of one ``group`` with different ``variant``, the smaller id first, each once.

    The distinct variants of a group are paired, by 128-bit digests; the ids of the one and then of the other variant are
    joined on, so that no two ids of one variant ever meet. Only groups of two variants or more are joined at all. The
    ids of a hot variant are spread by their hash, and its pairs of variants are copied to each part.
    """
    slim = df.select(F.md5(group).alias("g"), F.md5(F.concat_ws("\x1f", group, variant)).alias("v"), "id")
    variants = slim.groupBy("g", "v").agg(F.count("*").alias("n"))
    many = variants.groupBy("g").count().where("count > 1").select("g")
    met = variants.join(many, "g", "left_semi").withColumn("parts", (F.col("n") / F.lit(hot_rows) + 1).cast("int")).select("g", "v", "parts")
    ids = slim.select("v", "id").join(met.select("v", "parts"), "v").select("v", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("s"), "id")
    a = met.select("g", F.col("v").alias("va"), F.col("parts").alias("pa"))
    b = met.select("g", F.col("v").alias("vb"), F.col("parts").alias("pb"))
    of_variants = a.join(b, "g").where("va < vb").select("va", "vb", "pb", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("sa"))
    one = of_variants.join(ids.select(F.col("v").alias("va"), F.col("s").alias("sa"), F.col("id").alias("a")), ["va", "sa"]).select("a", "vb", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("sb"))
    two = one.join(ids.select(F.col("v").alias("vb"), F.col("s").alias("sb"), F.col("id").alias("b")), ["vb", "sb"]).where("a <> b")
    return two.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
