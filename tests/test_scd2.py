"""Type-two history against a sequential version, on both paths, and merges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scd2
from tidemark.session import cut

SCHEMA = "e string, v int, at bigint, s string, r bigint, id string, entity string"


def brute(rows):
    out, by = set(), {}
    for e, v, at, s, r, i, _ in rows:
        if e is not None:
            by.setdefault(e, {}).setdefault(v, []).append((r if r is not None else -1, i or "", at, s))
    for e, versions in by.items():
        line = {}
        for v, xs in versions.items():
            _, _, at, s = max(xs, key=lambda x: (x[0], x[1]))
            if at is not None and (at not in line or v > line[at][0]):
                line[at] = (v, s)
        marks, before = [], None
        for at in sorted(line):
            v, s = line[at]
            if s != before:
                marks.append((at, v, s))
                before = s
        for (at, v, s), nxt in zip(marks, [*marks[1:], (None,)]):
            if s is not None:
                out.add((e, v, at, nxt[0]))
    return out


def run(df, loads=scd2.LOADS):
    h = scd2.history(df, "e", "v", F.col("at"), F.when(F.col("s").isNotNull(), scd2.state_hash([F.col("s")])), "r", "id", loads)
    return {(r.entity, r.version, r.valid_from, r.valid_to) for r in h.collect()}


@pytest.mark.parametrize("hot, loads", [(scd2.HOT_ROWS, 2), (20, 4), (20, 1)])
def test_against_sequential(spark, monkeypatch, hot, loads):
    """However many batches the deliveries come in, late and replacing ones among them, the history is that of the whole."""
    monkeypatch.setattr(scd2, "HOT_ROWS", hot)
    rng = random.Random(hot)
    rows = [(rng.choice("aaaaaabc"), rng.randrange(200), rng.randrange(150) if rng.random() > 0.02 else None, rng.choice(["x", "y", "z", None]), rng.randrange(9), f"i{k}", "clash") for k in range(400)]
    rows += rows[:30] + [(None, 1, 1, "x", 1, "n", "c")]
    assert run(spark.createDataFrame(rows, SCHEMA), loads) == brute(rows)


def test_edges(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == set()
    null_first = [("a", 1, 1, None, 1, "i", ""), ("a", 2, 2, "x", 1, "j", ""), ("a", 3, 3, None, 1, "k", ""), ("a", 4, 4, "x", 1, "l", "")]
    assert run(spark.createDataFrame(null_first, SCHEMA)) == {("a", 2, 2, 3), ("a", 4, 4, None)}


def test_merge_touches_only_what_a_batch_names(spark):
    state = F.struct(F.lit(1).alias("r"), F.lit("").alias("id"))
    rows = lambda xs: spark.createDataFrame(xs, "entity string, version int, at bigint, hash string").withColumn("rank", state)
    look = lambda d: {(r.entity, r.version): (r.valid_from, r.valid_to) for r in d.collect()}
    step = lambda d, b: cut(scd2.merge(d, b))
    one = step(None, rows([("a", 1, 1, "x"), ("a", 2, 2, "x"), ("a", 3, 3, "y"), ("b", 1, 1, "x"), ("c", 1, 1, None)]))
    assert look(one) == {("a", 1): (1, 3), ("a", 2): (None, None), ("a", 3): (3, None), ("b", 1): (1, None), ("c", 1): (None, None)}
    two = step(one, rows([("a", 4, 9, "y"), ("a", 5, 10, None), ("c", 2, 2, "z")]))  # confirms, closes, opens
    assert look(two) == {("a", 1): (1, 3), ("a", 2): (None, None), ("a", 3): (3, 10), ("a", 4): (None, None), ("a", 5): (None, None), ("b", 1): (1, None), ("c", 1): (None, None), ("c", 2): (2, None)}
    late = step(two, rows([("a", 6, 2, "q"), ("b", 1, 5, "x")]).withColumn("rank", F.struct(F.lit(2).alias("r"), F.lit("").alias("id"))))  # a late one of an equal time, and a replacement
    assert look(late)[("a", 6)] == (2, 3) and look(late)[("a", 1)] == (1, 2) and look(late)[("b", 1)] == (5, None)
    assert look(step(late, rows([]))) == look(late)
