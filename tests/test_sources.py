"""Parsers on small payloads of every source kind."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import textual
from tidemark.sources import apis, feeds, files, pages
from tidemark.sources.contract import RECORD, rejects


def payloads(spark, *bodies, source="s", url="https://news.site.example/list"):
    return spark.createDataFrame([(source, url, b, None) for b in bodies], "source_id string, url string, body string, fetched_at timestamp")


def rows(df):
    return {r["external_id"]: r for r in df.collect()}


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed</title>
<item><title>One agent</title><link>https://a.example/x//y/?utm_source=q&amp;b=2&amp;a=1</link><guid>g1</guid><description>D</description><content:encoded>Full</content:encoded><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>No link</title><guid>g2</guid></item>
<item><title>No guid</title><link>https://a.example/z</link></item></channel></rss>"""


def test_rss(spark):
    got = rows(feeds.rss(payloads(spark, RSS, "broken <")))
    assert len(got) == 2
    assert got["g1"].canonical_url == "https://a.example/x/y?a=1&b=2"
    assert got["g1"].content == "Full"
    assert str(got["g1"].published_at).startswith("2024-01-02 03:04:05")
    other = next(r for k, r in got.items() if k != "g1")
    assert len(other.external_id) == 64
    assert feeds.rss(payloads(spark)).count() == 0
    assert feeds.proceedings(payloads(spark, RSS)).count() == 1
    assert feeds.rss(payloads(spark, RSS), max_items=1).count() == 1
    assert {r["malformed"] for r in feeds.feed_warnings(payloads(spark, RSS, "")).collect()} == {1}


def test_preprints(spark):
    entry = lambda v, t: f'<entry><id>http://arxiv.org/abs/2401.00001v{v}</id><title>{t}</title><summary>S</summary><published>2024-01-01T00:00:00Z</published><updated>2024-01-0{v}T00:00:00Z</updated><author><name>A B</name></author><link rel="alternate" href="https://arxiv.org/abs/2401.00001v{v}"/><link rel="related" href="https://github.com/x/y"/><category term="cs.AI"/></entry>'
    body = f'<feed xmlns="http://www.w3.org/2005/Atom">{entry(1, "old")}{entry(2, "new")}<entry><id>nonsense</id></entry></feed>'
    got = rows(feeds.preprint_atom(payloads(spark, body)))
    assert list(got) == ["2401.00001"]
    r = got["2401.00001"]
    assert r.title == "new" and r.metadata["version"] == "2" and r.metadata["code_url"] == "https://github.com/x/y" and r.authors == ["A B"]


def test_harvest(spark):
    rec = lambda i, status, versions: f'<record><header{status}><identifier>oai:{i}</identifier><datestamp>2024-01-05</datestamp></header><metadata><arXivRaw><id>{i}</id>{versions}<title> T </title><authors>A One, B Two and C Three</authors><abstract>See https://github.com/q/w.</abstract></arXivRaw></metadata></record>'
    v = '<version version="v1"><date>Mon, 1 Jan 2024 00:00:00 GMT</date></version><version version="v2"><date>Tue, 2 Jan 2024 00:00:00 GMT</date></version>'
    deleted = ' status="deleted"'
    body = f"<OAI-PMH><ListRecords>{rec('2401.1', '', v)}{rec('2401.2', deleted, v)}</ListRecords></OAI-PMH>"
    r = rows(feeds.harvest(payloads(spark, body)))
    assert list(r) == ["2401.1"]
    assert r["2401.1"].authors == ["A One", "B Two", "C Three"]
    assert r["2401.1"].metadata["code_url"] == "https://github.com/q/w"
    assert r["2401.1"].canonical_url.endswith("2401.1v2")


def test_sitemap_and_volumes(spark):
    body = "<urlset>" + "".join(f"<url><loc>https://s.example/blog/{x}</loc><lastmod>2024-03-01</lastmod></url>" for x in ("a-new-idea-2024-02-03", "x", "two-words")) + "<url><loc>https://s.example/jobs/other-page</loc></url></urlset>"
    got = feeds.sitemap(payloads(spark, body), ["/blog/"]).collect()
    assert sorted(r.title for r in got) == ["A New Idea", "Two Words"]
    page = '<a href="/v3/">3</a><a href="v12">12</a><a href=/v3>again</a>'
    assert [r.volume for r in feeds.volumes(payloads(spark, page), 1).collect()] == [12]


def test_apis(spark):
    note = {"id": "n1", "content": {"title": {"value": "An  agent"}, "abstract": "x", "authors": {"value": ["A"]}}, "pdate": 1704067200000, "mdate": 1704153600000, "invitations": ["V/Camera_Ready"]}
    plain = {"id": "n2", "content": {"title": "Cooking"}}
    got = rows(apis.conference_notes(payloads(spark, json.dumps({"notes": [note, plain, note]}))))
    assert list(got) == ["n1"] and got["n1"].title == "An agent" and got["n1"].metadata["acceptance_status"] == "camera_ready" and got["n1"].authors == ["A"]
    rel = [{"id": 7, "name": "", "tag_name": "v1", "html_url": "https://github.com/a/b/releases/v1", "draft": False}, {"id": 8, "draft": True, "html_url": "https://github.com/a/b"}]
    got = rows(apis.releases(payloads(spark, json.dumps(rel), "{}")))
    assert list(got) == ["7"] and got["7"].title == "v1"
    got = rows(apis.models(payloads(spark, json.dumps([{"modelId": "o/m", "downloads": 3}, {"likes": 1}])), "dataset"))
    assert list(got) == ["o/m"] and "/datasets/o/m" in got["o/m"].canonical_url


def test_filings(spark):
    recent = {"accessionNumber": ["0-4", "0-3", "0-2", "0-1"], "filingDate": ["2024-05-04", "2024-05-03", "2024-05-02", "2024-05-01"], "form": ["8-K", "XX", "4", "10-K"], "primaryDocument": ["a.htm", "", "b.htm", "c.htm"]}
    p = payloads(spark, json.dumps({"cik": "00012", "name": "Co", "filings": {"recent": recent}}))
    today = F.lit("2024-05-04").cast("date")
    assert set(rows(apis.filings(p, today))) == {"0-4", "0-2", "0-1"}
    seen = spark.createDataFrame([("s", "0-1")], "source_id string, external_id string")
    got = apis.filings(p, today, last_seen=seen)
    assert set(rows(got)) == {"0-4", "0-2"}
    assert set(rows(apis.filings(p, today, lookback_days=3))) == {"0-4", "0-2"}
    assert [r.external_id for r in apis.detail_candidates(got).collect()] == ["0-4"]


def test_announcements_and_standards(spark):
    codes = spark.createDataFrame([("s", "600000")], "source_id string, code string")
    row = {"SECURITY_CODE": "600000", "SECURITY_NAME": "N", "TITLE": "T", "URL": "/disclosure/listedinfo/announcement/c/d1.pdf", "SSEDATE": "2024-01-02"}
    bad = [{**row, "SECURITY_CODE": "1"}, {**row, "URL": "/x/../d.pdf"}, {**row, "TITLE": ""}]
    got = rows(apis.exchange_announcements(payloads(spark, json.dumps({"result": [row, row, *bad]})), codes))
    assert list(got) == ["d1"] and str(got["d1"].published_at).startswith("2024-01-01 16:00")
    a = {"announcementId": "5", "announcementTitle": "<em>Big</em> news", "adjunctUrl": "finalpage/2024/x.PDF", "announcementTime": 1704067200000, "secName": "N"}
    got = rows(apis.disclosure_announcements(payloads(spark, json.dumps({"announcements": [a, {**a, "announcementId": "6", "adjunctUrl": "//evil/x.pdf"}]}))))
    assert list(got) == ["5"] and got["5"].title == "N · Big news"
    s = spark.createDataFrame([("s", "u", json.dumps({"rows": [{"id": "A1_b-0001", "C_C_NAME": "<b>Name</b>"}, {"id": "A1", "C_C_NAME": "short"}, {"id": "bad id", "C_C_NAME": "x"}]}), t) for t in ("t2", "t1")], "source_id string, url string, body string, term string")
    got = rows(apis.standards(s))
    assert list(got) == ["A1_b-0001"] and got["A1_b-0001"].metadata["matched_terms"] == "t1, t2"


def test_pages(spark):
    page = '<a href="/news/one">One story</a><a href="https://news.site.example/news/one#x">again</a><a href="https://other.example/n">Other</a><a href="/about">About</a>'
    got = pages.listing(payloads(spark, page), include_urls=["/news/"]).collect()
    assert [(r.title, r.canonical_url) for r in got] == [("One story", "https://news.site.example/news/one")]
    art = """<title>T</title><meta property="og:title" content="OG"><script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","headline":"LD","url":"https://site.example/c?ref=1","author":[{"name":"Ann"}],"datePublished":"2024-01-01T00:00:00Z"}]}</script>
    <nav>Menu</nav><main><header>Head</header><p>Body &amp; <a href="https://github.com/a/b">code</a></p><form>Sign up</form><script>x</script></main><p>After</p>"""
    r = pages.articles(payloads(spark, art, None)).where("title = 'LD'").first()
    assert r.canonical_url == "https://site.example/c"
    assert r.content == "Body & code" and r.metadata["code_url"] == "https://github.com/a/b" and r.authors == ["Ann"] and str(r.published_at).startswith("2024-01-01")
    o = pages.outline('<a href="/x">one <b>two</b></a><a href="/lost">never closed <a href="/y">three</a><p>a<a>no address</a>')
    assert pages.anchors(o) == [("/x", "one two"), ("/y", "three")]
    index = '<a href="/events/acl-2024/">x</a><a href=/events/acl-2024>y</a><a href="/events/acl-2019/">z</a><a href="/volumes/acl-2024/">v</a>'
    assert [r.url for r in pages.event_links(payloads(spark, index).limit(1), [2024, 2023]).collect()] == ["https://news.site.example/events/acl-2024"]
    assert pages.parse_article('<script type="application/ld+json">[broken</script>')["title"] is None
    acl = '<a href="/2024.acl-long.1/">An <b>agent</b></a><a href=/2024.acl-long.2>Cooking</a><div id="abstract-2024--acl-long--1" class=c><div class="card-body p-3">Text</div></div>'
    got = rows(pages.anthology_events(payloads(spark, acl)))
    assert list(got) == ["2024.acl-long.1"] and got["2024.acl-long.1"].summary == "Text" and got["2024.acl-long.1"].title == "An agent"
    assert payloads(spark, "<p>a</p><style>b</style>").select(pages.document_text("body").alias("t")).first().t == "a"


def test_dispatch_files_and_fragments(spark, tmp_path):
    p = payloads(spark, RSS, source="a").unionByName(payloads(spark, RSS, source="b"))
    got, unknown = files.parse(p, {"a": "rss", "b": "no such kind"})
    assert got.count() == 2 and unknown == ["b"]
    assert rejects(p, got).where("source_id = 'b'").first().records == 0
    assert files.parse(spark.createDataFrame([], p.schema), {"a": "rss"})[0].count() == 0
    good = tmp_path / "ok.jsonl"
    good.write_text('# c\n\n{"id": "1", "x": 2}\n')
    assert files.label_lines(spark, str(good), "id string, x int", "id").count() == 1
    good.write_text('{"id": "1"}\n{"id": "1"}\n')
    with pytest.raises(ValueError):
        files.label_lines(spark, str(good), "id string", "id")
    c = files.config_rows(spark, [{"id": "a", "extra": 1}], {"kind": "rss"}, ["id", "kind"]).first()
    assert c.kind == "rss" and c.config == {"extra": "1"}
    (tmp_path / "o/2024/01/02").mkdir(parents=True)
    (tmp_path / "o/2024/01/02/x").write_text("abc")
    o = files.object_listing(spark, str(tmp_path / "o")).first()
    assert str(o.day) == "2024-01-02" and o.bytes == 3
    d = spark.createDataFrame([('event: a\ndata: {"x":1}\n\ndata: {"x":2}\n',), ('{"x":3}',), ("[1]",), (None,)], "b string")
    assert [r[0] for r in d.select(apis.last_event_data(F.col("b"))).collect()] == ['{"x":2}', '{"x":3}', None, None]
    d = spark.createDataFrame([('```json\n{"a":1}\n```',), ("no",)], "b string")
    assert [r[0] for r in d.select(apis.fenced_object(F.col("b"))).collect()] == ['{"a":1}', None]
    assert "external_id string" in RECORD


def test_long_pages(spark, tmp_path):
    page = "<article><p>" + "word " * 30_000 + "end</p></article>"
    spark.createDataFrame([("1", page.encode()), ("2", b"<p>b</p>")], "record_id string, raw_snapshot binary").write.parquet(str(tmp_path / "collected_items.parquet"))
    assert {r.record_id: r.chars for r in textual.html_article(spark, str(tmp_path)).collect()} == {"1": 150_003, "2": 0}
    assert payloads(spark, page).select(pages.document_text("body").alias("t")).first().t.endswith("word end")
    assert [len(r.content) for r in pages.articles(payloads(spark, page), pages.ARTICLE_MOST).collect()] == [50_000]


ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><id>urn:1</id><title>T</title><link rel="self" href="https://a.example/self"/><link href="https://a.example/p?utm_source=x"/><summary>S</summary><author><name>Ann</name></author><updated>2024-01-02T00:00:00Z</updated></entry><entry><id>urn:2</id><title>no link</title></entry></feed>'


def test_atom_under_rss_and_whole_dispatch(spark):
    got = rows(feeds.rss(payloads(spark, ATOM)))
    assert list(got) == ["urn:1"] and got["urn:1"].canonical_url == "https://a.example/p" and got["urn:1"].authors == ["Ann"] and str(got["urn:1"].updated_at).startswith("2024-01-02")
    p = payloads(spark, ATOM, source="a")
    assert files.parse(p, {"a": "sec_submissions"})[1] == ["a"]  # its needed option isn't given
    assert files.parse(p, {"a": "sitemap"}, {"sitemap": {"patterns": []}})[1] == []
    assert len(files.PARSERS) == 15


def test_first_of_repeated_rows_stays(spark):
    a = {"announcementId": "5", "announcementTitle": "first", "adjunctUrl": "finalpage/2024/x.pdf"}
    body = json.dumps({"announcements": [a, {**a, "announcementTitle": "second"}] * 20})
    assert [r.title for r in apis.disclosure_announcements(payloads(spark, body)).collect()] == ["first"]


def test_cursors(spark):
    t = lambda d: f"2024-01-{d:02} 00:00:00"
    parsed = spark.createDataFrame([("a", t(5), None), ("a", t(3), t(4)), ("b", None, None)], "source_id string, updated_at string, published_at string").selectExpr("source_id", "updated_at::timestamp", "published_at::timestamp")
    old = spark.createDataFrame([("a", t(1)), ("b", t(2)), ("c", t(9))], "source_id string, watermark string").selectExpr("source_id", "watermark::timestamp")
    got = {r.source_id: (str(r.watermark), str(r.ask_from)) for r in apis.watermark_after(parsed, old).collect()}
    assert got == {"a": (t(5), "2024-01-04 12:00:00"), "b": (t(2), "2024-01-01 12:00:00"), "c": (t(9), "2024-01-08 12:00:00")}
    n = spark.createDataFrame([("a", 1, 50), ("a", 2, 50), ("b", 1, 50), ("b", 2, 3)], "source_id string, page int, entries int")
    assert {r.source_id: (r.finished, r.notice) for r in apis.page_notices(n, 50, 2).collect()} == {"a": (False, "page budget of 2 used up"), "b": (True, None)}
    oai = lambda token: f"<OAI-PMH><ListRecords><record/><resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"
    h = spark.createDataFrame([("a", 0, t(1), oai("")), ("a", 1, t(2), oai("tok")), ("b", 1, t(1), oai("x")), ("b", 1, t(2), oai(" ")), ("c", 0, t(1), oai(""))], "source_id string, set_index int, fetched_at string, body string")
    got = {r.source_id: (r.set_index, r.resumption_token, r.done) for r in apis.harvest_cursor(h, 2).collect()}
    assert got == {"a": (1, "tok", False), "b": (2, None, True), "c": (1, None, False)}
    c = spark.createDataFrame([("a", "e", "m", t(9), "x")], "source_id string, etag string, last_seen_id string, watermark string, note string").withColumn("watermark", F.col("watermark").cast("timestamp"))
    r = apis.rewound(c, F.lit(t(1))).first()
    assert (r.etag, r.last_seen_id, str(r.watermark), r.note) == (None, None, t(1), "x")
