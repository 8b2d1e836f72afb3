"""Look-alikes, page bodies, tokens, packing and reading levels."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lookalike, mainbody, packing, reading, tokenize

VOCAB = os.path.join(tokenize.TOKENIZERS, tokenize.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files")


# --- look-alikes


def test_table_and_trie_agree():
    rng = random.Random(2)
    words = ["Latency", "café", "déjà-vu", "phở-bench", "2024", "fi", "office", "用", "(filing"]
    s = lookalike.Speller(words)
    swaps = {"a": "аａ𝖺", "e": "еｅ", "o": "оοօ", "c": "сϲ", "i": "іｉ", "y": "у", "L": "ᏞＬ", "用": "⽤"}
    for _ in range(500):
        w = rng.choice(words)
        t = "".join(rng.choice(swaps[ch]) if ch in swaps and rng.random() < 0.6 else ch for ch in w)
        t = "".join(ch + rng.choice(["", "​", "­", "͏"]) for ch in t)
        if rng.random() < 0.5:
            import unicodedata

            t = unicodedata.normalize("NFD", t)
        assert s.token(t) == lookalike.by_table(t) == w
    assert s.token("оﬀіce") == "office"


def test_visible_differences_stay():
    for a, b in [("Latency", "latency"), ("cafe", "café"), ("l", "1"), ("I", "l"), ("a-b", "a b"), ("x2", "x²"), ("a.", "a"), ("version 1", "version 2")]:
        assert lookalike.Speller([]).text(a) != lookalike.Speller([]).text(b)


def test_the_walk_settles_letters_of_two_readings():
    s = lookalike.Speller(["Interpret", "learning", "AI"])
    assert lookalike.by_table("Ӏearning") == "Iearning" and s.token("Ӏearning") == "learning"
    assert s.token("Ӏnterpret") == "Interpret" and s.token("AӀ") == "AI" and s.token("ӏearn\u00ading") == "learning"
    assert s.token("Ӏong") == "Iong"  # no word holds it: the table's first reading
    assert lookalike.Speller(["Al", "AI"]).token("AӀ") == "Al"  # the commoner word


def test_hot_variant_is_spread(spark):
    """A hundred thousand equal titles and two that look the same: no two of the equal ones ever meet."""
    from tidemark.llm.pairs import pairs_within

    hot = spark.range(100_000).select(F.format_string("h%06d", "id").alias("id"), F.lit("form").alias("f"), F.lit("Form").alias("t"))
    few = spark.createDataFrame([("a", "form", "Fоrm"), ("z", "form", "F​orm"), ("q", "other", "x")], "id string, f string, t string")
    got = pairs_within(hot.unionByName(few), "f", "t", 1000)
    assert got.count() == 200_001
    assert got.where("id_a = 'a'").count() == 100_001 and got.where("id_b = 'z'").count() == 100_001


def test_edit_automaton_with_a_bound():
    t = lookalike.Trie()
    for w in ("kitten", "sitting", "mitten"):
        t.add(w)
    assert t.match("kitten") == (0.0, "kitten")
    assert t.match("kiten", 1.0) == (1.0, "kitten")
    assert t.match("kittens", 1.0) == (1.0, "kitten")
    assert t.match("sittin", 1.0) == (1.0, "sitting")
    assert t.match("bitten", 1.0) == (1.0, "kitten")
    assert t.match("bitten", 0.0) is None


def test_pairs_edges(spark):
    rows = [("a", "Open  Report", "x"), ("b", "Оpen Report", "x"), ("b", "Оpen Report", "x"), ("c", "Open Report", "x"), ("d", "Open Report", "x"), ("e", None, "x"), (None, "Open Report", "x"), ("f", "", "x"), ("g", "​", "x"), ("h", "OPEN REPORT", "x"), ("i", "w" * 30_000, "x")]
    df = spark.createDataFrame(rows, "k string, t string, form string")
    got = {tuple(r) for r in lookalike.same_looking_pairs(df, "item", "k", "t").collect()}
    assert got == {("item", "a", "b"), ("item", "a", "c"), ("item", "a", "d"), ("item", "b", "c"), ("item", "b", "d")}
    assert lookalike.same_looking_pairs(df.limit(0), "item", "k", "t").count() == 0
    forms = {r.k: r.f for r in df.select("k", lookalike.one_form(F.col("t"), []).alias("f")).collect()}
    assert forms["e"] is None and forms["f"] == "" and forms["g"] == ""


# --- page bodies

PAGE = """<html><head><title>A story of rivers | Site</title></head>
<body>
<nav>
<p>Home</p>
<p>About us</p>
</nav>
<article>
<h1>A story of rivers</h1>
<p>By Ann Other | 2024-01-01</p>
<p>The river runs past the old mill and turns, slowly, to the sea.</p>
<p>Share this article</p>
<p>Fishermen say that the water has never been clearer than this year.</p>
</article>
<footer>
<p>© 2024 Site</p>
<p>All rights reserved.</p>
<p>The mill sells bread and keeps the road open in winter for everyone.</p>
</footer>
</body></html>"""


def labelled():
    rng = random.Random(1)
    words = "river mill sea water year road bread winter fishermen open old turns clearer slow stone bridge light town".split()
    pages = []
    for i in range(40):
        paras = "\n".join("<p>The " + " ".join(rng.choice(words) for _ in range(12)) + ".</p>" for _ in range(4))
        pages.append(f"<html><body>\n<nav>\n<p>Home</p>\n<p>About us</p>\n<p>Share this article</p>\n</nav>\n<article>\n<h1>Title number {i} of them</h1>\n{paras}\n</article>\n<footer>\n<p>All rights reserved.</p>\n<p>Subscribe to our newsletter</p>\n</footer>\n</body></html>")
    return pages


def test_article_lines():
    w = mainbody.fit(labelled())
    assert mainbody.article_lines(PAGE, True, None, w) == [8, 10, 12]
    plain = "Home\nAbout us\nA story of rivers\nBy Ann Other | 2024-01-01\nThe river runs past the old mill and turns, slowly, to the sea.\nShare this article\nFishermen say that the water has never been clearer.\n© 2024 Site\nThe mill sells bread and keeps the road open in winter for everyone."
    assert mainbody.article_lines(plain, False, "A story of rivers", w) == [3, 5, 7]
    assert mainbody.article_lines("Home\nAbout us\nAll rights reserved.", False, None, w) == []
    assert mainbody.article_lines("", False, None, w) == []


def test_article_lines_without_a_stop():
    w = mainbody.fit(labelled())
    page = PAGE.replace("<p>Share this article</p>", "<h3>The old mill and the slow river</h3>\n<li>The river turns past the mill and the old bridge -</li>\n<li><a href='/x'>The river turns past the mill and the old bridge</a></li>\n<p>Share this article</p>")
    assert mainbody.article_lines(page, True, None, w) == [8, 10, 11, 12, 15]


def test_body_edges(spark):
    rows = [(f"p{i}", p.encode(), None, None) for i, p in enumerate(labelled())] + [("x", PAGE.encode(), None, "clash"), ("x", PAGE.encode(), None, "clash"), ("n", None, None, None), ("b", b"\xff\xfe broken", "", None), ("long", None, "The river runs to the sea and the mill.\n" * 20_000, None)]
    df = spark.createDataFrame(rows, "record_id string, raw binary, content string, title string").withColumn("line_no", F.lit(1))
    got = mainbody.body_lines(df, "record_id", "content", "raw", "title")
    assert sorted(r.line_no for r in got.where("record_id = 'x'").collect()) == [8, 10, 12]
    assert got.where("record_id in ('n', 'b')").count() == 0
    assert got.where("record_id = 'long'").count() == 20_000
    assert mainbody.body_lines(df.limit(0), "record_id", "content", "raw", "title").count() == 0


# --- tokens


@needs_vocabulary
def test_tokens_against_library():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "aB1 2  \n\t\r  　'smtdrelv\"!.,é中𝖠²​́\x1c\x85\x00<|endoftext|>"
    texts = ["", None, "'s", " 's", "''s", "don't", "DON'T", "a" * 5000, " " * 300, "\n\n x"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(20_000)]
    ids, at, cut, slices = tokenize.encode(texts, VOCAB)
    for i, t in enumerate(texts):
        got = ids[at[i] : at[i + 1]].tolist()
        assert got == (ref.encode_ordinary(t) if t else [])
        assert tokenize.decode(got) == (t or "")
    assert cut[-1] == sum(len((t or "").encode()) for t in texts) and slices[-1] == len(cut) - 1


@needs_vocabulary
def test_token_operator_edges(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "CACHE", 5)
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (4, "one two three four five six seven", "x"), (None, "k", "x")], "id bigint, t string, ids string")
    got = [(r.id, len(r.ids)) for r in tokenize.token_ids(df, "id", "t").collect()]
    assert sorted(got, key=str) == sorted([(1, 2), (1, 2), (2, 0), (3, 0), (4, 7), (None, 1)], key=str)
    assert tokenize.token_counts(df.limit(0), "id", "t").count() == 0
    ids, at, _, _ = tokenize.encode(["one two three four five six seven", "eight nine ten"], VOCAB)
    assert tokenize.decode(ids.tolist()) == "one two three four five six seveneight nine ten"


@needs_vocabulary
def test_slices_of_one_hash_are_told_apart(monkeypatch):
    texts = ["one two three", None, "", "four, five and six", "sieben acht"]
    want = [x.tolist() if hasattr(x, "tolist") else x for x in tokenize.encode(texts, VOCAB)[:2]]
    tokenize.merger.cache_clear()
    hashes = tokenize._hashes
    monkeypatch.setattr(tokenize, "_hashes", lambda data, cut, which=0: hashes(data, cut, which) if which else np.zeros(len(cut) - 1, np.uint64))
    got = [x.tolist() for x in tokenize.encode(texts, VOCAB)[:2]]
    tokenize.merger.cache_clear()
    assert got == want


# --- packing


def test_packing_core():
    rng = random.Random(3)
    sizes = [min(100, int(rng.lognormvariate(2.5, 0.9)) + 1) for _ in range(5000)]
    fill = {}
    for (box, start), s in zip(packing.pack(sizes, 100), sizes):
        assert fill.get(box, 0) == start and start + s <= 100
        fill[box] = start + s
    assert len(fill) <= 1.02 * sum(sizes) / 100 + 1
    assert packing.pack([], 10) == []
    assert packing.pack([10, 10], 10) == [(0, 0), (1, 0)]


@pytest.mark.parametrize("block", [10_000, 60])
def test_packing_operator(spark, block):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, None, 7, 20, 33, 50, 99, 100, 101, 250])) for i in range(300)] + [(5, 7), (None, 3)]
    df = spark.createDataFrame([(*r, "clash") for r in sizes], "k bigint, n bigint, box string")
    rows = packing.pack_documents(df, "k", "n", 100, block).collect()
    fill, total = {}, 0
    for r in rows:
        assert (r.container is None) == (r.n_tokens == 0)
        if r.container is not None:
            fill.setdefault(r.container, []).append((r.start, r.n_tokens))
            total += r.n_tokens
    assert total == sum(n or 0 for _, n in sizes)
    for parts in fill.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 100
    pieces = {}
    for r in rows:
        pieces.setdefault(r.k, []).append(r.n_tokens)
    for k, n in sizes:
        if k is not None and k != 5 and (n or 0) <= 100:
            assert pieces[k] == [n or 0]  # not split
    assert len(fill) <= 1.1 * total / 100 + 3
    assert packing.pack_documents(df.limit(0), "k", "n", 100).count() == 0


@pytest.mark.parametrize("low, high, full", [(1025, 2047, False), (600, 1100, False), (1, 300, True)])
def test_packing_turns_are_bounded(spark, monkeypatch, low, high, full):
    """Sizes that can't be combined end after one turn; no task ever packs more than a block."""
    rng = random.Random(8)
    sizes = [rng.randrange(low, high) for _ in range(2000)]
    turns, seen = [], []
    packed = packing._packed

    def watched(items, capacity, blocks, turn):
        turns.append(turn)
        seen.append(items.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks))).count().agg(F.max("count")).first()[0])
        return packed(items, capacity, blocks, turn)

    monkeypatch.setattr(packing, "_packed", watched)
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(sizes)), "k bigint, n bigint"), "k", "n", 2048, 100).collect()
    assert max(turns) <= packing.TURNS + 1 and (low < 1024 or turns == [1]) and max(seen) <= 100
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert len(rows) == 2000 and sum(fill.values()) == sum(sizes) and max(fill.values()) <= 2048 and min(fill) >= 0
    if full:
        assert sum(sizes) >= 0.98 * 2048 * (len(fill) - 1)


def test_full_pieces_are_numbered_apart(spark):
    df = spark.range(0, 3000, 1, 60).select(F.col("id").alias("k"), F.lit(4096 * 3 + 5).cast("bigint").alias("n"))
    rows = packing.pack_documents(df, "k", "n", 4096, 500).collect()
    whole = [r.container for r in rows if r.n_tokens == 4096]
    assert len(whole) == len(set(whole)) == 9000 and len(rows) == 12_000


# --- reading levels


def test_syllables():
    assert [reading.syllables(w, "en") for w in ("table", "make", "reading", "jumped", "wanted", "idea", "the", "rhythm")] == [2, 1, 2, 1, 2, 2, 1, 1]
    assert [reading.syllables(w, "de") for w in ("haus", "prüfung", "verantwortung")] == [1, 2, 4]
    assert [reading.syllables(w, "fr") for w in ("table", "parlent", "idée")] == [1, 1, 2]
    assert [reading.syllables(w, "es") for w in ("casa", "poesía", "tarea")] == [2, 4, 3]


def test_thresholds_are_optimal():
    import itertools

    import numpy as np

    rng = random.Random(8)
    v = np.array([rng.choice([1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for _ in range(40)])
    y = np.array([float(min(4, max(1, round(x / 1.5 + rng.gauss(0, 0.7))))) for x in v])
    level = lambda cuts: sum((v >= c).astype(int) for c in cuts) + 1
    best = min(np.abs(level(c) - y).sum() for c in itertools.combinations_with_replacement([0.5, 1.5, 2.5, 3.5, 4.5, 5.5, float("inf")], 3))
    got = reading.thresholds(v, y)
    assert list(got) == sorted(got) and np.abs(level(got) - y).sum() == best


def test_levels(spark):
    rng = random.Random(9)
    easy, hard = "cat dog sun hat run big red".split(), "institutional characterization responsibility interoperability".split()
    docs, labels = [], []
    for i in range(200):
        lvl = 1 + i % 4
        s = [" ".join(rng.choice(hard if rng.random() < (lvl - 1) / 4 else easy) for _ in range(4 + 6 * lvl)) + "." for _ in range(12)]
        docs.append((i, " ".join(s), "en", "clash"))
        labels.append((i, "r", lvl))
    docs += [(900, None, "en", ""), (901, "short text.", "en", ""), (902, docs[0][1], "zh", ""), (903, docs[0][1], None, ""), (904, docs[3][1] * 200, "en", ""), (905, "1 2 3 " * 50, "en", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, reading_level string")
    lab = spark.createDataFrame(labels + [(0, "r", None), (0, "r", 1), (None, "q", 2), (5000, "r", 9)], "doc_id bigint, reviewer string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(d, lab).collect()}
    assert set(got) == {*range(200), 904}
    assert sum(got[i] == lvl for i, _, lvl in labels) >= 180 and got[904] == 4
    assert reading.reading_levels(d.limit(0), lab).count() == 0
    assert set(r.reading_level for r in reading.reading_levels(d, lab.limit(0)).collect()) <= {1, 2, 3, 4}
