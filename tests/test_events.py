"""Event and item operators beside plain Python, with nulls, ties, repeated rows and empty tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsons, rules, text
from tidemark.operators import events as ev


def t(day):
    return datetime(2024, 1, day)


def test_ledger(spark):
    schema = "event_id string, content_hash string, revision_no int, status string, at timestamp, id string, e string"
    current = spark.createDataFrame([("a", "x", 3, "NEW_ENTITY", t(1), "1", ""), ("a", "y", 7, "MINOR_UPDATE", t(2), "2", ""), ("b", None, 2, "NEW_ENTITY", t(1), "3", "")], schema)
    batch = spark.createDataFrame([("a", "x", 0, "MINOR_UPDATE", t(9), "4", ""), ("a", "q", 0, "NEW_ENTITY", t(5), "5", ""), ("a", "p", 0, "MATERIAL_UPDATE", t(4), "6", ""), ("a", "p", 0, "MINOR_UPDATE", t(8), "7", ""), ("b", "z", 0, "NEW_ENTITY", None, "8", ""), ("c", "n", 0, "DISCOVERED_LATE", t(1), "9", ""), (None, "n", 0, "NEW_ENTITY", t(1), "10", ""), ("c", None, 0, "NEW_ENTITY", t(1), "11", "")], schema)
    got = {(r.event_id, r.content_hash): (r.revision_no, r.status, r.is_material) for r in ev.ledger(current, batch, "event_id", "content_hash", ["at", "id"]).collect()}
    assert got == {("a", "x"): (3, "MINOR_UPDATE", False), ("a", "p"): (8, "MINOR_UPDATE", False), ("a", "q"): (9, "NEW_ENTITY", True), ("b", "z"): (3, "NEW_ENTITY", True), ("c", "n"): (1, "DISCOVERED_LATE", True)}
    assert ev.ledger(current, batch.limit(0), "event_id", "content_hash", ["at", "id"]).count() == 0


def test_selection(spark):
    r = spark.createDataFrame([("a", 1, "1", "NEW_ENTITY", t(1)), ("a", 2, "2", "MATERIAL_UPDATE", t(2)), ("a", 3, "3", "MATERIAL_UPDATE", t(9)), ("b", 1, "4", "MINOR_UPDATE", t(1)), ("c", 1, "5", "NEW_ENTITY", t(1)), ("d", 1, "6", "NEW_ENTITY", t(1)), ("e", 1, "7", "NEW_ENTITY", None)], "event_id string, revision_no int, id string, status string, created_at timestamp")
    used = spark.createDataFrame([("5", "digest", "k1"), ("2", "alert", "k2"), ("6", "digest", "own")], "revision_id string, kind string, delivery_key string")
    got = {r.id for r in ev.select_unused(r, used, "digest", "own", F.lit(t(5))).collect()}
    assert got == {"2", "6"}  # one used in another kind only, one used by the delivery itself


def test_same_items_against_union_find(spark):
    rng = random.Random(4)
    rows = [(f"k{i:03}", rng.choice("st"), rng.choice([f"n{rng.randrange(60)}", None]), rng.choice([f"u{rng.randrange(60)}", None]), "x") for i in range(150)]
    rows += rows[:5] + [(None, "s", "n1", "u1", "x")] + [(f"z{i:03}", "s", f"c{i}", f"c{i + 1 if i % 2 else i}", "x") for i in range(12)]
    parent = {r[0]: r[0] for r in rows if r[0]}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in rows:
        for y in rows:
            if x[0] and y[0] and x[1] == y[1] and ((x[2] and x[2] == y[2]) or (x[3] and x[3] == y[3])):
                a, b = sorted((find(x[0]), find(y[0])))
                parent[b] = a
    df = spark.createDataFrame(rows, "k string, source string, native string, url string, item string")
    assert {r.k: r.item for r in ev.same_items(df, "source", "native", "url", "k").collect()} == {k: find(k) for k in parent}
    assert ev.same_items(df.limit(0), "source", "native", "url", "k").count() == 0


def test_aliases_of_several_words(spark):
    names = spark.createDataFrame([(n,) for n in ("Acme", "Acme Robotics Lab", "安全", "安全研究院", "org-12", "a&b co", "", None, "acme", "one two three four five six seven")], "n string")
    texts = ["The ACME robotics lab opens", "acmeology", "国家安全研究院发布", "see org-12.", "see org-123", "org 12", "A&B Co wins", None, "", "acme and acme", "one two three four five six seven", "one two three four five six eight"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.name for r in ev.aliases_in(df, "k", "t", names, "n").collect()}
    assert got == {0: "Acme Robotics Lab", 2: "安全研究院", 3: "org-12", 6: "a&b co", 9: "acme", 10: "one two three four five six seven"}


def test_filters_sections_and_public_fields(spark):
    e = spark.createDataFrame(
        [("a", ["mechanistic_interpretability"], ["x"], "MATERIAL_UPDATE", 50, t(1), t(20), "https://a.example/1", ["https://b.example", "javascript:x", "https://b.example"]), ("b", None, None, "NEW_ENTITY", 150, t(19), t(2), "ftp://x", None), ("c", ["safety_governance"], [], "NEW_ENTITY", -5, t(2), None, None, [])],
        "event_id string, topics array<string>, entities array<string>, status string, score int, first_seen_at timestamp, material_updated_at timestamp, primary_url string, corroborating_urls array<string>",
    )
    ids = lambda df: {r.event_id for r in df.collect()}
    assert ids(ev.filter_events(e, {"topic": None})) == {"a", "b", "c"}
    assert ids(ev.filter_events(e, {"min_score": 50, "status": "NEW_ENTITY"})) == {"b"} and ids(ev.filter_events(e, {"entity": "x"})) == {"a"}
    assert ids(ev.filter_events(e, {}, F.lit(t(21)), 5)) == {"a", "b"}  # a counts by its material update, b by first sight
    with pytest.raises(ValueError):
        ev.filter_events(e, {"mail": "x"})
    got = {r.section: r.n for r in ev.section_counts(e, "topics").collect()}
    assert got["safety_governance"] == 2 and got["mechanistic_interpretability"] == 1 and got["long_horizon"] == 0
    rest = [c for c in ev.PUBLIC if c not in e.columns]
    shown = ev.public_events(e.select("*", *[F.lit(None).cast("string").alias(c) for c in rest]).withColumn("api_key", F.lit("k")), F.col("primary_url").startswith("https://"))
    assert tuple(shown.columns) == ev.PUBLIC
    r = {x.event_id: x for x in shown.collect()}
    assert r["a"].corroborating_urls == ["https://b.example"] and r["b"].primary_url is None and r["b"].topics == [] and (r["b"].score, r["c"].score) == (100, 0)


def test_dataset_files(spark, tmp_path):
    e = spark.createDataFrame([("a", t(1)), ("b", t(2)), ("c", datetime(2024, 2, 1))], "event_id string, first_seen_at timestamp")
    health = spark.createDataFrame([("s1", "healthy", t(1)), ("s2", "failing", None), ("s3", "disabled", t(9))], "id string, status string, last_at timestamp")
    facets = spark.createDataFrame([("status", "NEW", 2), ("status", "OLD", 1)], "facet string, value string, n bigint")
    ev.write_dataset(e, health, facets, "first_seen_at", str(tmp_path))
    read = lambda n: spark.read.json(f"{tmp_path}/{n}")
    assert {r.month: r.events for r in read("months").collect()} == {"2024-01": 2, "2024-02": 1}
    assert read("events").where("month = '2024-01'").count() == 2 and read("window").first().events == 3
    h = read("health").first()
    assert (h.healthy, h.attention, h.notices) == (1, 1, ["s2: failing"]) and read("facets").first().counts.asDict() == {"NEW": 2, "OLD": 1}


def test_rules(spark):
    df = spark.createDataFrame([("We plan an IPO and a merger", "rss"), ("a new data center of gpus", "rss"), ("capital expenditure on desks", "rss"), ("nothing", "arxiv_api"), ("nothing", "github_releases")], "t string, k string")
    assert [r[0] for r in df.select(rules.event_type(F.col("t"), F.col("k"))).collect()] == ["IPO_FILING", "CAPEX_COMPUTE", "PUBLICATION", "PAPER", "RELEASE"]
    f = spark.createDataFrame([("S-1/A", None), ("SC 13G", None), ("8-K", "Item 1.01"), ("6-K", "2.01"), ("8-K", "3.02"), ("10-K", "1.01"), (None, None)], "f string, i string")
    assert [r[0] for r in f.select(rules.filing_event_type(F.col("f"), F.col("i"), F.lit("x"))).collect()] == ["IPO_FILING", "OWNERSHIP", "MATERIAL_CONTRACT", "M_AND_A", "RAISE", "x", "x"]
    v = ("reported_unconfirmed", "company_claim", "verified_primary", "corroborated")
    pairs = spark.createDataFrame([(a, b) for a in v for b in v], "a string, b string")
    got = {(r.a, r.b): r.c for r in pairs.select("a", "b", rules.combined_verification(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[v[0], v[0]] == v[0] and got[v[0], v[1]] == v[1] and got[v[2], v[2]] == v[3] and got[v[1], v[2]] == v[3] and got[v[3], v[0]] == v[3]
    assert all(got[a, b] == got[b, a] for a in v for b in v)


def test_changes_and_json(spark):
    row = ("A &amp; B", "The summary.", "", "1", "A & B", "Another one altogether.", "", "2")
    df = spark.createDataFrame([row, (*row[:5], "The  summary.", "", "1")], "t0 string, s0 string, b0 string, v0 string, t1 string, s1 string, b1 string, v1 string")
    side = lambda i: {"title": F.col(f"t{i}"), "summary": F.col(f"s{i}"), "body": F.col(f"b{i}")}
    meta = lambda i: lambda k: F.col(f"v{i}") if k == "version" else F.lit(None).cast("string")
    a, b = (r[0] for r in df.select(text.change_phrases(side(0), side(1), meta(0), meta(1), F.lit(False))).collect())
    assert a.startswith("版本 1→2；核心摘要 ") and b == text.OTHER_CHANGE  # white space and entities are no change
    assert df.select(text.change_phrases(side(0), side(1), meta(0), meta(1), F.lit(True))).first()[0] == text.MINOR
    body = spark.createDataFrame([("x" * 100, "y" * 100, "html"), ("x" * 100, "y" * 100, "pmlr"), ("", "y", "html"), ("a  b", "a b", "rss"), (None, None, "rss")], "a string, b string, k string")
    assert [r[0] for r in body.select(text.body_changed(F.col("a"), F.col("b"), F.col("k"))).collect()] == [True, False, False, False, False]
    j = spark.createDataFrame([('{"delivery":{"message_id":"d"},"message_id":"m"}',), ('{"message_id":"m"}',), ("{}",), ("broken",), (None,)], "j string")
    assert [r[0] for r in j.select(jsons.first_path(F.col("j"), jsons.MESSAGE_PATHS)).collect()] == ["d", "m", None, None, None]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"a": "1"}), (None, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in m.select(jsons.merged(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": None, "c": "3"}, {"a": "1"}, {}]
    i = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.25",), ("2024-01-02T05:04:05+02:00",), ("no",), (None,)], "t string")
    assert [r[0] for r in i.select(jsons.iso_utc(jsons.from_iso(F.col("t")))).collect()] == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250000Z", "2024-01-02T03:04:05Z", None, None]
    assert str(spark.range(1).select(jsons.send_at(F.lit("2024-01-02"))).first()[0]) == "2024-01-02 05:45:00"
    p = spark.createDataFrame([("a/b: c",), ("--",), ("x" * 200,)], "t string")
    assert [r[0] for r in p.select(text.path_label(F.col("t"))).collect()] == ["a-b-c", "unknown", "x" * 120]
