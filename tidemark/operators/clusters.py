"""Greedy clustering in order, without a sequential pass.

Sequentially, every row in its order joins the most similar earlier root within reach, or becomes a root. That is the
first maximal independent set of the graph of similar rows in that order, which rounds of joins compute; members then
take the most similar of the earlier roots. Only edges travel, never a group.

Edges come from sign bands of random projections (recall 0.9999 at a cosine of 0.92) and are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import cosine
from tidemark.session import cut

BANDS, BITS = 48, 12


def similar_edges(df: DataFrame, key: str, vector: str, block: list[str], least: float, dims: int, at: str | None = None, within: int | None = None) -> DataFrame:
    """(a, b, similarity): pairs of one block with a cosine of ``least`` or more, a < b. Unusable vectors have no edges.

    With ``within``, only pairs whose ``at`` differs by no more than that; they meet in their own or the next span of it.
    """
    planes = np.random.RandomState(5).randn(dims, BANDS * BITS)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bands(v: pd.Series) -> pd.Series:
        x = np.array([np.asarray(e, dtype=np.float64) if e is not None and len(e) == dims else np.zeros(dims) for e in v]).reshape(-1, dims)
        bits = (np.nan_to_num(x) @ planes > 0).reshape(-1, BANDS, BITS)
        return pd.Series(list((bits * (1 << np.arange(BITS))).sum(axis=2) + (np.arange(BANDS) << BITS)))

    rows = df.where(F.size(vector) == dims).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.xxhash64(*block).alias("g"), (F.col(at) if within else F.lit(0)).cast("bigint").alias("t"), *block)
    keyed = rows.select("k", "g", "t", F.floor(F.col("t") / F.lit(within or 1)).alias("span"), F.explode(bands("v")).alias("band"))
    other = keyed.select(F.col("k").alias("b"), "g", "band", F.col("t").alias("u"), F.explode(F.array(*[F.col("span") + i for i in (-1, 0, 1)])).alias("span") if within else "span")
    met = keyed.withColumnRenamed("k", "a").join(other, ["g", "band", "span"]).where("a < b").where(F.abs(F.col("t") - F.col("u")) <= (within or 0)).select("a", "b").distinct()
    vecs = rows.select("k", "v", F.struct(*block).alias("s"))
    both = met.join(vecs.select(F.col("k").alias("a"), F.col("v").alias("va"), F.col("s").alias("sa")), "a").join(vecs.select(F.col("k").alias("b"), F.col("v").alias("vb"), F.col("s").alias("sb")), "b")
    return both.where("sa <=> sb").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity")).where(F.col("similarity") >= least)


def roots_of(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(k): the first maximal independent set of a graph in the order of its nodes (k, o).

    A node is out as soon as an earlier neighbour is in, and in once all earlier neighbours are out; chains of equal
    rows settle in two rounds, and the number of rounds grows with the logarithm of the rows for orders that don't
    follow the edges.
    """
    two = edges.select(F.col("a").alias("k"), F.col("b").alias("e")).unionByName(edges.select(F.col("b").alias("k"), F.col("a").alias("e")))
    back = cut(two.join(nodes, "k").join(nodes.select(F.col("k").alias("e"), F.col("o").alias("eo")), "e").where("eo < o").select("k", "e"))
    state = cut(nodes.select("k").join(back.select("k").distinct().withColumn("has", F.lit(True)), "k", "left").select("k", F.when(F.col("has").isNull(), True).alias("is_root")))
    for _ in range(max_rounds):
        open_ = state.where("is_root is null")
        if not open_.take(1):
            return state.where("is_root").select("k")
        seen = back.join(open_.select("k"), "k", "left_semi").join(state.select(F.col("k").alias("e"), F.col("is_root").alias("er")), "e")
        verdict = seen.groupBy("k").agg(F.max("er").alias("any_in"), F.count_if(F.col("er").isNull()).alias("waiting"))
        settled = verdict.where("any_in or waiting = 0").select("k", (~F.coalesce("any_in", F.lit(False))).alias("new"))
        state = cut(state.join(settled, "k", "left").select("k", F.coalesce("is_root", "new").alias("is_root")))
    raise RuntimeError("roots didn't settle; raise max_rounds")


def greedy_clusters(df: DataFrame, key: str, vector: str, block: list[str], order: Column, least: float, dims: int, at: Column | None = None, within: int | None = None) -> DataFrame:
    """(key, root): the cluster of every row as the sequential pass would give it. ``order`` must be unique.

    Rows of equal vectors in one block form a class. Only its first row can be a root, since what keeps the first from
    being one keeps the others too; so the graph is built of first rows, and a hot vector adds one node to it. A row
    without a usable vector (or with a null in its block) is its own root.

    With ``within``, a row joins only roots whose ``at`` (a whole number) differs from its own by no more than that (C7);
    a class is then of equal ``at`` too, as its rows otherwise have unlike roots in reach.
    """
    usable = F.size(vector) == dims
    for b in block:
        usable = usable & F.col(b).isNotNull()
    usable = usable & at.isNotNull() if within else usable
    rows = df.select(F.col(key).alias("k"), order.alias("o"), F.col(vector).alias("v"), *[F.col(b).alias(f"b{i}") for i, b in enumerate(block)], (at if within else F.lit(0)).cast("bigint").alias("t"), F.coalesce(usable, F.lit(False)).alias("fine"))
    names = [f"b{i}" for i in range(len(block))]
    fine = rows.where("fine").withColumn("h", F.xxhash64("v"))
    first = fine.groupBy(*names, "t", "h", "v").agg(F.min(F.struct("o", "k")).alias("x")).select(*names, "t", "h", "v", F.col("x.k").alias("k"), F.col("x.o").alias("o"))
    edges = cut(similar_edges(first, "k", "v", names, least, dims, "t", within))
    roots = cut(roots_of(first.select("k", "o"), edges).join(first.select("k", "o"), "k"))
    members = fine.select("k", "o", "t", "h", "v", *names).join(first.select(*names, "t", "h", "v", F.col("k").alias("c")), [*names, "t", "h", "v"]).select("k", "o", "c")
    two = edges.select(F.col("a").alias("c"), F.col("b").alias("r"), "similarity").unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("r"), "similarity"))
    reach = two.unionByName(roots.select(F.col("k").alias("c"), F.col("k").alias("r"), F.lit(1.0).alias("similarity"))).join(roots.select(F.col("k").alias("r"), F.col("o").alias("ro")), "r")
    best = members.join(reach, "c").where("ro <= o").groupBy("k").agg(F.max(F.struct("similarity", "r")).alias("x")).select("k", F.col("x.r").alias("root"))
    return rows.select("k").join(best, "k", "left").select(F.col("k").alias(key), F.coalesce("root", "k").alias("root"))
