"""State tables, schemas and small parsers."""

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.identity import query_state
from tidemark.functions.times import retry_at
from tidemark.operators import state


def test_upsert_and_ignore(spark):
    cur = spark.createDataFrame([("a", 1, "old"), ("b", 9, "old")], "k string, t int, v string")
    new = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("c", 1, None)], "k string, t int, v string")
    assert {(r.k, r.v) for r in state.upsert(cur, new, ["k"], ["t"]).collect()} == {("a", "old"), ("b", "y"), ("c", None)}
    assert {tuple(r) for r in state.insert_or_ignore(cur, new, ["k"], ["t"]).collect()} == {("c", 1, None)}
    assert state.upsert(cur, new.limit(0), ["k"], ["t"]).count() == 2


def test_cursors(spark):
    cur = spark.createDataFrame([("a", "e1", "m1"), ("b", None, None)], "s string, etag string, mod string")
    new = spark.createDataFrame([("a", None, "m2"), ("c", "e3", None)], "s string, etag string, mod string")
    got = {r.s: (r.etag, r.mod) for r in state.carry_forward(cur, new, ["s"], {"mod": F.lit("never")}).collect()}
    assert got == {"a": ("e1", "m2"), "b": (None, "never"), "c": ("e3", "never")}


def test_streaks_and_due(spark):
    runs = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 1, False), ("a", 3, 1, True), ("a", 4, 1, True), ("b", 1, 1, True), ("c", 1, 1, False)], "k string, at int, i int, f boolean")
    got = {r.k: (r.failures, r.last_success) for r in state.failure_streaks(runs, "k", "at", "i", F.col("f")).collect()}
    assert got == {"a": (2, 2), "b": (1, None), "c": (0, 1)}
    s = spark.createDataFrame([("a", True, None, None), ("b", True, 9, None), ("c", True, None, 9), ("d", False, None, None)], "id string, enabled boolean, retry_at int, next_due_at int")
    assert [r.id for r in state.due(s, F.lit(5)).collect()] == ["a"]
    assert [r.id for r in state.due(s, F.lit(5), force=True).orderBy("id").collect()] == ["a", "c"]


def test_enrich(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")

    def fine(p):
        return p.assign(n=p["k"].str.len())

    def fails(p):
        raise ValueError

    assert {tuple(r) for r in state.enrich(df, fine, "k string, n bigint").collect()} == {("a", 1), ("b", 1)}
    assert {tuple(r) for r in state.enrich(df, fails, "k string, n bigint").collect()} == {("a", None), ("b", None)}
    assert state.enrich(df, None, "").count() == 2
    local = lambda p: p.assign(n=-1)
    assert {tuple(r) for r in state.enrich(df, fails, "k string, n bigint", status="who", fallback=local).collect()} == {("a", -1, "fallback"), ("b", -1, "fallback")}
    assert {r.who for r in state.enrich(df, fine, "k string, n bigint", status="who").collect()} == {"provider"}
    with pytest.raises(Exception, match="m"):  # a wrong schema is no provider's error
        state.enrich(df, fine, "k string, m bigint").collect()


def test_schema_check(spark):
    good = spark.createDataFrame([], schemas.TABLES["cursors"])
    assert schemas.check(good, "cursors") is good
    with pytest.raises(ValueError, match="etag: missing"):
        schemas.check(good.drop("etag"), "cursors")


def test_small_parsers(spark):
    df = spark.createDataFrame([("120",), ("Tue, 02 Jan 2024 00:00:00 GMT",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(F.unix_micros(retry_at(F.col("t"), F.lit("2024-01-01").cast("timestamp")))).collect()]
    day = 1_704_067_200_000_000
    assert got == [day + 120_000_000, day + 86_400_000_000, None, None]
    q = spark.createDataFrame([("?topic=a&range=7d&x=1&topic=b+c",), ("range=9y",), (None,), ("",)], "q string")
    assert [r[0] for r in q.select(query_state(F.col("q"), {"topic": None, "range": ["7d", "30d"]})).collect()] == [{"topic": "b c", "range": "7d"}, {}, {}, {}]
