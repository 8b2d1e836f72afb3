"""Identity, text, vector and rule expressions."""

import hashlib
import math
import random
import time

from pyspark.sql import functions as F

from tidemark.functions import identity as ident
from tidemark.functions import rules, text, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_normalize(spark):
    cases = {"<p>a&amp;b</p>": "a&b", "x<script>var a</script>y": "x y", "a /* c */ b": "a b", "@media x { .a { b: '}' } } t": "t", ".k { color: red } t": "t", "best@16 { x": "best@16 { x", "ﬁ　x\x00y": "fi x y", "": "", "pass@k {a:b} z": "pass@k {a:b} z"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string").select("x", ident.normalize_content(F.col("x")).alias("y"))
    got = {r.x: r.y for r in df.collect()}
    assert got == {**cases, None: ""}


def test_normalize_is_linear():
    began = time.perf_counter()
    ident.plain_text("@media x {" * 20_000)
    ident.plain_text("best@16 {" * 20_000)
    ident.plain_text("'" + "{" * 100_000)
    assert time.perf_counter() - began < 20


def test_hashes(spark):
    want = hashlib.sha256("a b\x1fc".encode()).hexdigest()
    df = spark.createDataFrame([(" A  b", "C"), ("Ａ&nbsp;<i>b</i>", "ℂ"), ("a\x1db", "c")], "x string, y string")
    assert [r[0] for r in df.select(ident.stable_id(F.col("x"), F.col("y")).alias("i")).collect()] == [want] * 3
    assert one(spark, want, ident.stable_uuid) == f"{want[:8]}-{want[8:12]}-{want[12:16]}-{want[16:20]}-{want[20:32]}"


def test_urls(spark):
    cases = {"HTTPS://A.Example//x//y/?b=2&utm_source=q&a=1&ref=z#f": "https://a.example/x/y?a=1&b=2", "https://a.example/": "https://a.example/", "https://a.example": "https://a.example", "//a.example/x/": "https://a.example/x", "https://a.example/?k": "https://a.example/?k=", " https://a.example/p ": "https://a.example/p"}
    for k, v in cases.items():
        assert one(spark, k, ident.canonical_url) == v
    assert one(spark, None, ident.canonical_url) is None
    # the same query in another spelling, beside what the standard library makes of it
    from urllib.parse import parse_qsl, urlencode

    queries = ["a=%41&b=x+y", "b=x%20y&a=A", "q=%E4%B8%AD&z=*~", "q=中&z=%2A%7E", "k=100%&j", "x=1=2&x=1&X=0", "a=&a", "%75tm_source=1&b=é", "b=%C3%A9"]
    df = spark.createDataFrame([(f"http://h.example/p?{q}",) for q in queries], "u string").select("u", ident.canonical_url(F.col("u")).alias("c"))
    for r in df.collect():
        pairs = [(k, v) for k, v in parse_qsl(r.u.split("?", 1)[1], keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in ident.TRACKING_KEYS]
        assert r.c == "http://h.example/p?" + urlencode(sorted(pairs)), r.u


def test_record_hash(spark):
    """The hash over texts, address and the nine revision keys, beside plain Python."""
    import json

    meta = {"version": "2", "sha": 'a"b\\c', "code_url": None, "acceptance_status": "录用"}
    df = spark.createDataFrame([("T &amp; x", "S", None, "https://a.example/", meta)], "t string, s string, c string, u string, m map<string,string>")
    got = df.select(ident.record_hash(F.col("t"), F.col("s"), F.col("c"), F.col("u"), lambda k: F.col("m")[k])).first()[0]
    stated = json.dumps({k: v for k, v in meta.items() if v is not None}, ensure_ascii=False, sort_keys=True)
    assert got == hashlib.sha256(ident.plain_text("\n".join(["T &amp; x", "S", "", "https://a.example/", stated])).encode()).hexdigest()
    assert list(ident.REVISION_KEYS) == sorted(ident.REVISION_KEYS) and len(ident.REVISION_KEYS) == 9


def test_more_urls(spark):
    for k, v in {"https://a.b.example:8080/x": "b.example", "https://u:p@www.a.co.uk/": "a.co.uk", "nonsense": None, "https://host": "host"}.items():
        assert one(spark, k, ident.registrable_domain) == v
    assert [one(spark, u, ident.is_web_url) for u in ("https://a", "ftp://a", "http://", None)] == [True, False, False, False]
    r = one(spark, "http://arxiv.org/abs/2401.00001v3", ident.arxiv_identity)
    assert (r.id, r.version) == ("2401.00001", 3)
    assert one(spark, "none", ident.arxiv_identity) is None


def test_text(spark):
    assert one(spark, "the ipo of", lambda c: text.contains_term(c, "ipo")) is True
    assert one(spark, "hippo", lambda c: text.contains_term(c, "ipo")) is False
    assert one(spark, "长程任务", lambda c: text.contains_term(c, "程任")) is True
    assert one(spark, "https://a.example/x/some-new-thing-2024-01-02/?q", text.slug_title) == "Some New Thing"
    assert one(spark, "Ab-12 中文", text.tokens) == ["ab", "12", "中", "文"]
    df = spark.createDataFrame([("a" * 100, "a" * 99 + "b"), ("abc", "abc"), ("", "x"), ("a" * 100, "a" * 80), ("same words here", "quite other txt")], "o string, n string")
    assert [r[0] for r in df.select(text.text_changed(F.col("o"), F.col("n"))).collect()] == [False, False, True, True, True]
    assert [r[0] for r in df.select(text.first_change("o", "n")).collect()][:2] == ["a -> b", None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    v = vectors.hashed_features("agent agent memory", 64)
    assert math.isclose(sum(x * x for x in v), 1.0) and vectors.hashed_features("", 8) == [0.0] * 8
    assert [one(spark, x, lambda c: vectors.is_valid(c, 2), "array<float>") for x in ([1.0, 2.0], [1.0], [float("nan"), 1.0], [0.0, 0.0], None)] == [True, False, False, False, False]


def test_rules(spark):
    rs = [rules.TopicRule("t", hard=("agent",), boosters=("tool",), required=("model",), exempt=("long task",)), rules.TopicRule("k", kinds=("RAISE",))]
    df = spark.createDataFrame([("Agent model tool", "x"), ("agent only", "x"), ("agent long task", None), (None, "RAISE"), ("agents model", "x")], "t string, k string")
    got = [[(x.topic, x.strength) for x in r[0]] for r in df.select(rules.classify(F.col("t"), F.col("k"), rs)).collect()]
    assert got == [[("t", 22)], [], [("t", 20)], [("k", 16)], []]
    assert one(spark, "An open model", lambda c: rules.tags(c, {"o": ["open"], "p": ["closed"]})) == ["o"]


def test_long_texts(spark):
    rng = random.Random(1)
    noise = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    head = noise(12_000, "abcdefgh ")
    pairs = [(head + noise(3_000, "ijkl"), head + noise(3_000, "mnop")), (head + "x", head + "y"), (head + "x" + head, head + "y" + head)]
    df = spark.createDataFrame(pairs, "o string, n string")
    assert [r[0] for r in df.select(text.text_changed(F.col("o"), F.col("n"))).collect()] == [True, False, False]
    assert text.ratio_of(*pairs[0]) == 24_000 / 30_000 and text.ratio_of(*pairs[0], 10_000) == 1.0
