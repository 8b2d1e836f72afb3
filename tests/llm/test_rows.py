"""Neighbours, fusion and near-duplicates against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import fusion, nearduplicates, neighbours

VEC = "id string, v array<float>, space string, rep string"


def clouds(seed, n=400, dims=128):
    rng = np.random.RandomState(seed)
    centres = rng.randn(n // 8, dims)
    rows = []
    for i in range(n):
        v = centres[i % len(centres)] + rng.randn(dims) * rng.choice([0.25, 0.4])
        rows.append((f"v{i:04}", [float(x) for x in (v * rng.rand() * 5)], "ab"[i % 7 == 0], "clash"))
    return rows


def test_neighbours_recall(spark):
    rows = clouds(1)
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in neighbours.nearest(df, "id", "v", F.col("space")).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    hit = want = 0
    for i, a in enumerate(rows):
        near = sorted(((-s[i, j], b[0]) for j, b in enumerate(rows) if j != i and a[2] == b[2] and s[i, j] >= 0.8))[:5]
        want += len(near)
        hit += len({k for _, k in near} & got.get(a[0], set()))
        assert len(got.get(a[0], ())) <= 5 and a[0] not in got.get(a[0], ())
    assert want > 500 and hit >= 0.95 * want


def test_neighbours_edges(spark):
    one = [1.0, 2.0] + [0.5] * 126
    bad = [("n", None, "a", ""), ("s", [1.0] * 64, "a", ""), ("z", [0.0] * 128, "a", ""), ("f", [float("nan")] + one[1:], "a", ""), ("i", [float("inf")] + one[1:], "a", ""), ("p", one, None, ""), (None, one, "a", "")]
    copies = [(f"c{i:02}", one, "a", "") for i in range(20)] + [("c00", one, "a", ""), ("o", one, "b", "")]
    df = spark.createDataFrame(bad + copies, VEC)
    got = {}
    for r in neighbours.nearest(df, "id", "v", F.col("space")).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == {f"c{i:02}" for i in range(20)}
    assert all(len(v) == 5 and len(set(v)) == 5 and k not in v for k, v in got.items())
    assert got["c19"] == ["c00", "c01", "c02", "c03", "c04"] or sorted(got["c19"]) == ["c00", "c01", "c02", "c03", "c04"]
    assert neighbours.nearest(df.limit(0), "id", "v", F.col("space")).count() == 0
    assert neighbours.nearest(df.where("id = 'o'"), "id", "v", F.col("space")).count() == 0


def test_rotation_is_orthogonal():
    r = neighbours.learn_rotation(np.random.RandomState(0).randn(500, 128), 192)
    assert r.shape == (128, 192) and np.allclose(r[:, :128].T @ r[:, :128], np.eye(128), atol=1e-8)
    assert neighbours.learn_rotation(np.zeros((0, 128)), 192).shape == (128, 192)


def test_plan_follows_the_size():
    small, large = neighbours.plan(20_000, 0.8), neighbours.plan(10_000_000, 0.8)
    assert (small.width, large.width) == (15, 24) and large.parts > small.parts
    assert small.radius > small.width * small.parts * 0.205 and neighbours.plan(0, 0.8).width == 10


def test_codes_one_bit_apart_meet_from_one_side():
    p = neighbours.Plan(6, 2, 12)
    rng = np.random.RandomState(1)
    bits = rng.rand(40, 12) > 0.5
    own, more, count = neighbours.bucket_keys(bits, np.zeros(40, np.int64), p)
    looks = [set(x.tolist()) for x in np.split(more, np.cumsum(count)[:-1])]
    for i in range(40):
        for j in range(40):
            d = (bits[i].reshape(2, 6) != bits[j].reshape(2, 6)).sum(axis=1)
            for t in range(2):
                assert (own[i, t] == own[j, t]) == (d[t] == 0)
                assert ((own[j, t] in looks[i]) + (own[i, t] in looks[j])) == (d[t] == 1)


# --- fusion

ITEMS = "record_id string, external_id string, source_id string, summary string, authors array<string>, published_at string, collected_at timestamp, __zone string, __order string, worth string"


def test_worths(spark):
    df = spark.createDataFrame([("A whole one.",), ("Cut at the…",), ("Cut here [...]",), ("Goes on… Read more",), ("ends nowhere",), ("N/A",), ("",), (None,), ("Summary not provided by the publisher; please open the page.",), ("Ends (so).",)], "s string")
    assert [r[0] for r in df.select(fusion.summary_worth(F.col("s"))).collect()] == [2, 1, 1, 1, 1, 0, 0, 0, 0, 2]
    df = spark.createDataFrame([(["Ann Lee", "Bo Ray", "Ann Lee"],), (["A. Lee", "B. Ray"],), (["Ann Lee", "et al.", "and 9 others", "newsdesk", ""],), ([],), (None,), (["Ann Lee", None],)], "a array<string>")
    assert [r[0] for r in df.select(fusion.authors_worth(F.col("a"))).collect()] == [2, 0, 1, 0, 0, 1]
    urls = ["https://a.example/x?y", "http:///index.html", "https://?id=7", "about:blank", "n/a", "htps//mirror", "https://", None, "http://a.b.example:80/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(fusion.url_usable(F.col("u"))).collect()] == [True] + [False] * 7 + [True]


def test_survivors(spark):
    from datetime import datetime

    t = lambda d: datetime(2024, 5, d)
    rows = [
        ("r1", "g", "s1", "Short whole.", ["Ann Lee"], "2024-04-30T10:00:00Z", t(1), None, None, "x"),
        ("r2", "g", "s2", "A longer text that was cut…", ["Ann Lee", "Bo Ray"], "2024-04-30 10:00", t(2), None, None, "x"),
        ("r3", "g", "s3", "Another whole text.", ["A. Lee", "B. Ray", "C. Oh"], "1714471200", t(3), None, None, "x"),
        ("r4", "g", "s4", "N/A", None, "2099-12-31T00:00:00Z", t(4), None, None, "x"),
        ("r5", "alone", "s1", "Whole.", ["Ann Lee"], "1714471200", t(1), None, None, "x"),
        ("r6", "twice", "s1", "Whole.", None, None, t(1), None, None, "x"), ("r6", "twice", "s1", "Whole.", None, None, t(1), None, None, "x"),
        ("r7", None, "s1", "Whole.", None, None, t(1), None, None, "x"), (None, "g", "s1", "Whole.", None, None, t(9), None, None, "x"),
        ("r8", "tie", None, "Same.", None, None, t(1), None, None, "x"), ("r9", "tie", None, "Same.", None, None, t(1), None, None, "x"),
    ]
    df = spark.createDataFrame(rows, ITEMS)
    got = {(r.grp, r.field): r.key for r in fusion.survivors(fusion.item_claims(df)).collect()}
    assert got == {("g", "summary"): "r3", ("g", "authors"): "r2", ("g", "published_at"): "r3", ("tie", "summary"): "r8"}
    assert fusion.survivors(fusion.item_claims(df.limit(0))).count() == 0


def test_copied_votes_count_less(spark):
    """Sources that share many false values are found out: their common vote loses against independent sources."""
    rng = random.Random(3)
    rows = []
    for g in range(60):
        truth = f"t{g}"
        for s in ("a", "b", "c", "d"):
            rows.append((f"g{g}", f"{s}{g}", s, 1, "f", hash((g, truth if rng.random() < 0.85 else f"w{s}{g}")), 1))
        wrong = f"copied{g}"
        for s in ("x", "y", "z"):
            rows.append((f"g{g}", f"{s}{g}", s, 1, "f", hash((g, wrong)), 1))
    contested = [("q", f"{s}q", s, 1, "f", v, 1) for s, v in (("a", 1), ("b", 1), ("x", 2), ("y", 2), ("z", 2))]
    made = spark.createDataFrame(rows + contested, "grp string, key string, source string, seen bigint, field string, value bigint, worth int")
    got = {r.value: r.posterior for r in fusion.posteriors(made).where("grp = 'q'").collect()}
    assert got[1] > got[2]


def test_the_greatest_posterior_survives(spark):
    """Between values of one worth and one time the votes decide, and copied ones count less; worth and time come before."""
    rng = random.Random(3)
    rows = []
    for g in range(60):
        for s in ("a", "b", "c", "d"):
            rows.append((f"g{g}", f"{s}{g}", s, 1, "f", hash((g, f"t{g}" if rng.random() < 0.85 else f"w{s}{g}")), 1))
        rows += [(f"g{g}", f"{s}{g}", s, 1, "f", hash((g, "copied")), 1) for s in ("x", "y", "z")]
    rows += [("q", f"{s}q", s, 5, "f", v, 1) for s, v in (("a", 1), ("b", 1), ("x", 2), ("y", 2), ("z", 2))]
    rows += [("time", "aq", "a", 5, "f", 1, 1), ("time", "bq", "b", 5, "f", 1, 1), ("time", "xq", "x", 6, "f", 2, 1)]
    rows += [("worth", "aq", "a", 1 << 60, "f", 1, 1), ("worth", "xq", "x", None, "f", 2, 2)]
    made = spark.createDataFrame(rows, "grp string, key string, source string, seen bigint, field string, value bigint, worth int")
    got = {r.grp: r.key for r in fusion.survivors(made).where("grp in ('q', 'time', 'worth')").collect()}
    assert got == {"q": "aq", "time": "xq", "worth": "xq"}


MADE = "grp string, key string, source string, seen bigint, field string, value bigint, worth int"
CONTESTED = [("q", f"{s}q", s, 5, "f", v, 1) for s, v in (("a", 1), ("b", 1), ("x", 2), ("y", 2), ("z", 2))]


def test_sources_are_judged_by_votes_whenever_seen(spark):
    """Copied false values that are seen last in their groups don't make their sources the accurate ones."""
    rng = random.Random(5)
    rows = []
    for g in range(40):
        rows += [(f"g{g}", f"{s}{g}", s, i, "f", 0 if rng.random() < 0.85 else i, 1) for i, s in enumerate("abcd", 1)]
        rows += [(f"g{g}", f"{s}{g}", s, i, "f", 9, 1) for i, s in enumerate("xyz", 11)]
        rows += [(f"g{g}", f"cut{g}", "a", 99, "cut", 1, 1), (f"g{g}", f"whole{g}", "w", 1, "cut", 2, 2)]  # less worth is no mistake of a
    made = spark.createDataFrame(rows + CONTESTED, MADE)
    got = {r.grp: r.key for r in fusion.survivors(made).where("field = 'f' and grp in ('q', 'g0')").collect()}
    assert got == {"q": "aq", "g0": "z0"}


def test_copying_is_judged_where_both_claim(spark):
    """Mistakes made where the other source claims nothing don't hide that all common ones are shared."""
    rows = []
    for g in range(10):
        rows += [(f"g{g}", f"{s}{g}", s, 1, "f", 0, 1) for s in "abcd"] + [(f"g{g}", f"{s}{g}", s, 1, "f", 9, 1) for s in "xyz"]
        for s in "xyz":
            for n in "12":
                rows += [(f"{s}{n}{g}", f"{t}{n}{g}", t, 1, "f", 0 if t in "cd" else 9, 1) for t in "cd" + s]
    for g in range(80):
        rows += [(f"t{g}", f"{s}t{g}", s, 1, "f", 0, 1) for s in "cdxyz"]
    made = spark.createDataFrame(rows + CONTESTED, MADE)
    got = {r.grp: r.key for r in fusion.survivors(made).where("grp = 'q'").collect()}
    assert got == {"q": "aq"}


# --- near-duplicates

HOW = {"item": ("word", 3, 10), "event": ("character", 4, 0)}


def jaccard(a, b, kind):
    s, t = (set(nearduplicates.shingle_set(x, kind, HOW).tolist()) for x in (a, b))
    return len(s & t) / len(s | t) if s and t else 0.0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 80))]
        for c in range(rng.randrange(1, 6)):
            edited = [rng.choice(words) if rng.random() < 0.04 * c else w for w in base]
            rows.append(("item", f"i{g:02}{c}", None, " ".join(edited)))
    zh = "评测平台与外部伙伴合作简化了低成本的人工复核比例并计划下月开放试用"
    for g in range(25):
        text = "".join(rng.sample(zh, len(zh)))
        for c in range(3):
            rows.append(("event", f"e{g:02}{c}", f"k{g if c == 2 else g * 10 + c}", text[: 30 - 3 * c] + "。"))
    df = spark.createDataFrame(rows, "kind string, id string, apart string, text string")
    got = {tuple(r) for r in nearduplicates.near_duplicates(df, HOW, 0.5).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (a[2] is None or a[2] != b[2]) and jaccard(a[3], b[3], a[0]) >= 0.5}
    assert len(want) > 50 and got <= want and len(got) >= 0.98 * len(want)
    assert {tuple(r) for r in nearduplicates.near_duplicates(df, HOW, 0.5, exact=True).collect()} == want
    sure = {(k, a, b) for k, a, b in want for x in [dict(((r[0], r[1]), r[3]) for r in rows)] if jaccard(x[k, a], x[k, b], k) >= 0.62}
    assert sure <= got


def test_lower_bound():
    rng = random.Random(5)
    for _ in range(50):
        a = nearduplicates.word_shingles(" ".join(rng.choice("abcdefgh") for _ in range(200)), 3)
        b = nearduplicates.word_shingles(" ".join(rng.choice("abcdefgh") for _ in range(150)), 3)
        ca, cb = (np.frombuffer(nearduplicates.popcounts(x), np.uint8).astype(int) for x in (a, b))
        assert np.abs(ca - cb).sum() <= len(np.setxor1d(a, b))


def test_near_duplicate_edges(spark):
    same = "one two three four five six seven eight nine ten eleven"
    rows = [("item", "a", None, same, "x"), ("item", "a", None, same, "x"), ("item", "b", None, same.upper() + "!", "x"), ("item", "c", None, None, "x"), ("item", None, None, same, "x"), ("item", "d", None, "", "x"), ("item", "e", None, "too short", "x"), ("item", "f", None, "! " * 50, "x"), ("event", "g", "k", "abcd", "x"), ("event", "h", "k", "abcd", "x"), ("event", "i", "l", "ab cd", "x"), ("event", "j", None, "abc", "x"), ("item", "l", None, same + " " + " ".join(f"q{i}" for i in range(50_000)), "x")]
    df = spark.createDataFrame(rows, "kind string, id string, apart string, text string, n string")
    assert {tuple(r) for r in nearduplicates.near_duplicates(df, HOW, 0.5).collect()} == {("item", "a", "b"), ("event", "g", "i"), ("event", "h", "i")}
    assert nearduplicates.near_duplicates(df.limit(0), HOW, 0.5).count() == 0
