"""Inverted index and membership search: exact, prefix and fuzzy matches of query terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import tokens

#: Edits allowed are this share of a term's length, rounded.
FUZZY = 0.18
#: Indexed fields of an event with their weights.
EVENT_FIELDS = {"title_zh": 3.0, "entities": 2.0, "topics": 1.5, "summary_zh": 1.0, "why_it_matters": 1.0}


def postings(df: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(token, key, weight): each distinct token of a row with the summed weight of the fields it stands in; lists are flattened."""
    flat = {f: F.concat_ws(" ", f) if isinstance(df.schema[f].dataType, T.ArrayType) else F.col(f).cast("string") for f in fields}
    parts = [F.transform(F.array_distinct(tokens(F.coalesce(flat[f], F.lit("")))), (lambda w: lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))(w)) for f, w in fields.items()]
    return df.select(F.col(key).alias(key), F.explode(F.concat(*parts)).alias("x")).groupBy(F.col("x.token").alias("token"), key).agg(F.sum("x.w").alias("weight"))


def _hit(token: Column, term: str) -> Column:
    edits = round(FUZZY * len(term))
    hit = token.startswith(term)
    return hit | (F.levenshtein(token, F.lit(term), edits) >= 0) if edits else hit


def search(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, score): rows that hold any token of the terms, exactly, as a prefix or within the allowed edits.

    Terms are split like the indexed texts, so a Han word finds the rows that hold any of its characters: without the
    reference's dictionary of words none of its rows is lost, but others are found too.
    An exact match scores the token's weight, a prefix half of it, a fuzzy match a quarter; only membership is the
    contract, the score orders. No terms give no rows.
    """
    words = index.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(" ".join(terms)))).alias("t")).first().t
    if not words:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    worth = F.greatest(*[F.when(F.col("token") == w, 1.0).when(F.col("token").startswith(w), 0.5).when(_hit(F.col("token"), w), 0.25).otherwise(0.0) for w in words], F.lit(0.0))
    return index.withColumn("w", worth).where("w > 0").groupBy(key).agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
