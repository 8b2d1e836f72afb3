"""Relational, cluster, search, export and stream operators on small tables."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, clusters, export, search, versions
from tidemark.operators import relations as rel
from tidemark.plans import textual
from tidemark.streaming import jobs


def test_latest_and_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n")], "k string, t int, v string")
    assert {tuple(r) for r in rel.latest(df, ["k"], ["t", "v"]).collect()} == {("a", 2, "z"), ("b", None, "n")}
    assert rel.latest(df.limit(0), ["k"], ["t", "v"]).count() == 0
    assert [r.v for r in rel.top_per_key(df, ["k"], [F.desc("t"), F.col("v")], 1).orderBy("k").collect()] == ["y", "n"]


def test_related_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"k{i:03}", [rng.choice("hot hot hot a b c d".split()) for _ in range(rng.randrange(3))], rng.choice([None, "c1", "c2"]), rng.randrange(1000)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, e array<string>, c string, o int")
    got = {}
    for r in rel.related(df, "k", "e", "c", [F.col("o"), F.col("k")]).collect():
        got.setdefault(r.k, []).append((r["rank"], r.related))
    for k, e, c, _ in rows:
        want = [x for _, x in sorted((o2, k2) for k2, e2, c2, o2 in rows if k2 != k and (set(e) & set(e2) or (c and c == c2)))][:4]
        assert [x for _, x in sorted(got.get(k, []))] == want


def test_sets_and_facets(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "p string")
    got = {r.p: r.state for r in rel.reconcile(s("a", "b", "c", None), s("b", "c", "d"), s("c"), "p").collect()}
    assert got == {"a": "orphan", "b": "kept", "c": "protected", "d": "missing"}
    df = spark.createDataFrame([("x", ["p", "q"]), (None, None), ("x", ["p"])], "s string, t array<string>")
    assert {(r.facet, r.value): r.n for r in rel.facet_counts(df, ["s"], ["t"]).collect()} == {("s", "x"): 2, ("s", ""): 1, ("t", "p"): 2, ("t", "q"): 1}


def test_rotation_and_merge(spark):
    df = spark.range(10)
    ids = lambda off: {r.id for r in rel.rotate(df, [F.col("id")], 2, 3, off).collect()}
    assert ids(0) == {0, 1, 2, 3, 4} and ids(6) == {0, 1, 8, 9, 2} and ids(8) == ids(0)
    m = spark.createDataFrame([("k", 1, "", "b"), ("k", 2, "t", None), ("k", 3, "u", "c")], "k string, o int, x string, y string")
    assert tuple(rel.first_filled(m, ["k"], ["o"], ["x", "y"]).first()) == ("k", "t", "b")


def test_replay_and_retention(spark):
    df = spark.createDataFrame([("a", 1, "r1", "x"), ("a", 2, "r2", "x"), ("a", 3, "r3", "y"), ("a", 4, "r4", "x")], "k string, at int, id string, t string").withColumn("at", F.timestamp_seconds("at"))
    assert [(r.id, r.revision_no) for r in versions.replay(df, ["k"], "at", "id", F.col("t")).orderBy("at").collect()] == [("r1", 1), ("r3", 2), ("r4", 3)]
    rng = random.Random(2)
    many = spark.createDataFrame([(rng.choice("aaab"), f"2024-01-01 00:{rng.randrange(60):02}:00", f"r{i}", rng.choice("xyz")) for i in range(300)], "k string, at string, id string, t string").withColumn("at", F.col("at").cast("timestamp"))
    plain, blocked = ({tuple(r) for r in versions.replay(many, ["k"], "at", "id", F.col("t"), hot).collect()} for hot in (10_000, 20))
    assert plain == blocked and len(plain) > 100
    for f in (lambda hot: blocks.with_previous(many, ["k"], "at", "id", "t", "p", hot), lambda hot: blocks.numbered(many.withColumn("o", F.hash("id")), ["k"], "o", ["id"], "n", hot)):
        one, two = ({tuple(r) for r in f(hot).collect()} for hot in (10_000, 20))
        assert one == two and len(one) == 300
    v = spark.createDataFrame([("v1", "i", "2020-01-01"), ("v2", "i", "2020-02-01"), ("v3", "i", "2020-03-01"), ("v4", "j", "2024-01-01")], "id string, item_id string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    cur = spark.createDataFrame([("i", "v3"), ("j", "v4")], "item_id string, id string")
    got = {r.id: r.is_candidate for r in versions.retention(v, cur, spark.createDataFrame([("v9",)], "id string"), F.lit("2024-01-02").cast("timestamp")).collect()}
    assert got == {"v1": True, "v2": False, "v3": False, "v4": False}


def test_greedy_clusters_against_sequential(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(f"n{i:03}", rng.choice("pq"), [x + rng.gauss(0, 0.12) for x in rng.choice(base)], rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, t string, v array<double>, o double")
    rows += [(f"m{i:03}", "p", rows[0][2], rng.random()) for i in range(60)]
    df = spark.createDataFrame([*rows, ("none", "p", None, 0.5), ("short", "p", [1.0], 0.5), ("nowhere", None, rows[0][2], 0.0)], df.schema)
    got = {r.k: r.root for r in clusters.greedy_clusters(df, "k", "v", ["t"], F.struct("o", "k"), 0.92, 16).collect()}
    assert [got.pop(k) for k in ("none", "short", "nowhere")] == ["none", "short", "nowhere"]
    import numpy as np

    roots, want = [], {}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, _, v, _ in rows}
    kind = {k: t for k, t, _, _ in rows}
    for k, _, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        near = [(float(unit[k] @ unit[r]), r) for r in roots if kind[r] == kind[k] and unit[k] @ unit[r] >= 0.92]
        want[k] = max((round(x, 9), r) for x, r in near)[1] if near else k
        if not near:
            roots.append(k)
    assert got == want


def test_search(spark):
    df = spark.createDataFrame([("1", "Benchmark suite"), ("2", "governance rules"), ("3", "other"), ("4", None)], "id string, t string")
    idx = search.postings(df, "id", {"t": 3.0})
    hits = lambda *q: {r.id for r in search.search(idx, "id", list(q)).collect()}
    assert hits("bench") == {"1"} and hits("governence") == {"2"} and hits("zzz") == set() and hits() == set() and hits("bench", "oter") == {"1", "3"}


def _words(text):
    """Runs of letters, digits and their marks; each Han character alone."""
    out, run = [], ""
    for ch in text.lower() + " ":
        han = "CJK UNIFIED" in unicodedata.name(ch, "")
        kind = unicodedata.category(ch)[0]
        if not han and (kind in "LN" or kind == "M" and run):
            run += ch
            continue
        out += [run] * bool(run) + [ch] * han
        run = ""
    return set(out)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _brute(texts, terms):
    hit = lambda w, t: w.startswith(t) or _edits(w, t) <= round(0.18 * len(t))
    return any(hit(w, t) for x in texts for w in _words(x or "") for q in terms for t in _words(q))


def test_search_of_whole_tables(spark, tmp_path):
    titles = ["Benchmark suite", "Le benchmark de l’été", "Bench：benchmarks", "no\u00a0break governance", "发布benchmark新版", "gouvernance éthique", "governance", "be\u0301nchm", "评测", "bénch", None, ""]
    spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "record_id string, title string").write.parquet(str(tmp_path / "collected_items.parquet"))
    got = {r.record_id for r in textual.search_membership(spark, str(tmp_path)).collect()}
    assert got == {str(i) for i, t in enumerate(titles) if _brute([t], ["benchm", "governence"])} >= {"1", "2", "3", "4"}
    events = [
        ("title", "benchmark：新版", None, None, None, None), ("summary", "x", "通过benchmarks测试", "y", [], []), ("why", "x", "y", "governance 改善", [], []), ("entity", "x", "y", "z", ["org-a", "Benchmarkia"], []),
        ("topic", "x", "y", "z", [None], ["ai_governance", None]), ("han", "安全审议", "y", "z", [], []), ("none", "安全", "y", "z", [None], []),
    ]
    spark.createDataFrame(events, "event_id string, title_zh string, summary_zh string, why_it_matters string, entities array<string>, topics array<string>").write.parquet(str(tmp_path / "radar_events.parquet"))
    got = {r.event_id for r in textual.search_events(spark, str(tmp_path)).collect()}
    flat = lambda e: [y for x in e[1:] for y in (x if isinstance(x, list) else [x])]
    assert got == {e[0] for e in events if _brute(flat(e), ["benchm", "governence", "审查"])} == {"title", "summary", "why", "entity", "topic", "han"}
    index = search.postings(spark.read.parquet(str(tmp_path / "radar_events.parquet")), "event_id", search.EVENT_FIELDS)
    assert not search.search(index, "event_id", ["null"]).count()


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("https://a.example/x",)], "primary_url string")
    assert export.guard(df, ["primary_url"]).count() == 1
    with pytest.raises(ValueError):
        export.guard(df.select(F.struct(F.lit(1).alias("email")).alias("x")), [])
    with pytest.raises(Exception, match="unsafe address"):
        export.guard(spark.createDataFrame([("javascript:x",)], "primary_url string"), ["primary_url"]).collect()
    t = spark.createDataFrame([("2024-01-31",), ("2024-02-01",)], "d string").select(F.col("d").cast("timestamp").alias("at"))
    export.write_months(t, "at", str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").glob("month=*")) == ["month=2024-01", "month=2024-02"]


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4, "view" if i % 5 else "click") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: jobs.read_files(spark, str(tmp_path), "events", df.schema)
    got = jobs.tumbling_counts(stream(), "ts", "1 day", ["event_type"], jobs.workspace(spark))
    assert sum(r.n for r in got.collect()) == 60 and got.count() == 6
    rank = F.when(F.col("event_type") == "click", 1).otherwise(0)
    s = {r.user_id: (r.state, r.n) for r in jobs.ranked_states(stream(), "user_id", "event_type", rank, "ts", "event_id", jobs.workspace(spark)).collect()}
    assert s == {k: ("click", 15) for k in range(4)}
    v = jobs.version_stream(stream(), ["user_id"], "ts", "event_id", F.col("event_type"), jobs.workspace(spark))
    assert v.count() == 8
    # files that land later, with rows far behind what was seen, count as well; a run without new files changes nothing
    place, other = jobs.workspace(spark), jobs.workspace(spark)
    jobs.tumbling_counts(stream(), "ts", "1 day", ["event_type"], place), jobs.version_stream(stream(), ["user_id"], "ts", "event_id", F.col("event_type"), other)
    df.withColumn("ts", F.col("ts") - F.expr("INTERVAL 400 DAYS")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    for _ in range(2):
        more = jobs.tumbling_counts(stream(), "ts", "1 day", ["event_type"], place)
        touched = jobs.version_stream(stream(), ["user_id"], "ts", "event_id", F.col("event_type"), other)
    assert sum(r.n for r in more.collect()) == 120 and more.count() == 12 and touched.count() == 8
    assert {str(r.first_at)[:4] for r in touched.collect()} == {"2022"}
    for p in (tmp_path / "events.parquet").glob("part-00000*"):
        if spark.read.parquet(str(p)).agg(F.min("ts")).first()[0].year < 2024:
            p.unlink()
    place = jobs.workspace(spark)
    first = jobs.first_deliveries(stream(), "ts", "user_id", place)
    assert first.count() == 4
    assert jobs.first_deliveries(stream(), "ts", "user_id", place).count() == 4
    j = jobs.attach_late(stream(), stream().select("event_id", F.col("ts").alias("rt")), "event_id", "ts", "rt", "1 hours")
    place = jobs.workspace(spark)
    j.select("l.event_id").writeStream.format("parquet").option("path", place + "/o").option("checkpointLocation", place + "/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(place + "/o").count() == 60


def test_late_first_deliveries(spark, tmp_path):
    place = jobs.workspace(spark)
    seen = []
    for n, batch in enumerate(([("a", "2024-03-01", 1), ("a", "2024-03-02", 2), ("b", "2024-03-20", 3)], [("a", "2024-03-21", 4), ("b", "2024-02-01", 5), ("c", None, 6)], [("b", "2024-03-22", 7), ("c", "2024-01-01", 8)])):
        df = spark.createDataFrame(batch, "k string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
        rows = jobs.first_deliveries(jobs.read_files(spark, str(tmp_path), "in", df.schema), "ts", "k", place).collect()
        seen.append(sorted((r.k, r.id) for r in rows))
        assert {r.key for r in spark.read.parquet(f"{place}/v{n}").collect()} == [{"b"}, {"a", "b"}, {"a", "b"}][n]
    assert seen == [[("a", 1), ("b", 3)], [("a", 1), ("b", 5), ("c", 6)], [("a", 1), ("b", 5), ("c", 8)]]


def test_greedy_clusters_within_days(spark):
    rng = random.Random(7)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(f"n{i:03}", "p", [x + rng.gauss(0, 0.12) for x in rng.choice(base)], rng.randrange(-60, 60)) for i in range(120)]
    rows += [(f"m{i:03}", "p", rows[0][2], rng.randrange(-60, 60)) for i in range(40)]
    df = spark.createDataFrame([*rows, ("none", "p", rows[0][2], None)], "k string, t string, v array<double>, day int")
    got = {r.k: r.root for r in clusters.greedy_clusters(df, "k", "v", ["t"], F.struct(-F.col("day"), "k"), 0.92, 16, F.col("day"), 14).collect()}
    assert got.pop("none") == "none"
    import numpy as np

    unit = {k: np.array(v) / np.linalg.norm(v) for k, _, v, _ in rows}
    day = {k: n for k, _, _, n in rows}
    roots, want = [], {}
    for k in sorted(day, key=lambda k: (-day[k], k)):
        near = [(round(float(unit[k] @ unit[r]), 9), r) for r in roots if abs(day[k] - day[r]) <= 14 and unit[k] @ unit[r] >= 0.92]
        want[k] = max(near)[1] if near else k
        if not near:
            roots.append(k)
    assert got == want and len(roots) > 20
