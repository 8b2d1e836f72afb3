"""Queries of the source parsers: rows of the tables are written as the services answer, one payload a row, and parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.io import table
from tidemark.operators.export import escape_xml
from tidemark.sources import apis, feeds, pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL it must equal."""

    def mark(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return mark


def _payloads(df: DataFrame, body: Column, *more: str) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return df.select(F.coalesce("source_id", F.lit("")).alias("source_id"), F.lit("https://site.example/list").alias("url"), body.alias("body"), none.alias("fetched_at"), *more)


def _items(spark, d: str) -> DataFrame:
    # an answer's texts are one line of words: what a feed does to white space is not what is tested here
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}&<>\"',;:()-]+", " "))
    c = table(spark, d, "collected_items").select("record_id", "source_id", "title", "summary", "collected_at")
    # what pages say comes out in compatibility forms, so their texts are of plain letters
    ascii_ = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9&<>\"',;:()-]+", " "))
    return c.withColumn("t", plain(F.col("title"))).withColumn("s", plain(F.col("summary"))).withColumn("a", ascii_(F.col("title"))).withColumn("b", ascii_(F.col("summary")))


_PLAIN = r"""trim(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}&<>"'',;:()-]+', ' ', 'g'))"""
_ASCII = r"""trim(regexp_replace(coalesce({c}, ''), '[^a-zA-Z0-9&<>"'',;:()-]+', ' ', 'g'))"""
_I = f"(SELECT record_id, coalesce(source_id, '') AS source_id, collected_at, {_PLAIN.format(c='title')} AS t, {_PLAIN.format(c='summary')} AS s, {_ASCII.format(c='title')} AS a, {_ASCII.format(c='summary')} AS b FROM collected_items)"
_TERMS = " OR ".join(f"contains(lower(t || chr(10) || s), '{t}')" for t in feeds.FRONTIER_TERMS)
_text = lambda name, value: F.concat(F.lit(f"<{name}>"), escape_xml(value), F.lit(f"</{name}>"))
_key = lambda stem: F.concat(F.lit(stem), F.col("record_id"))
_rfc = lambda at: F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
_iso = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
_us = lambda c: F.unix_micros(c)
_SEC = "epoch_us(date_trunc('second', collected_at))"


@query(f"SELECT source_id, record_id AS external_id, 'https://a.example/x/' || record_id AS url, t AS title, s AS summary, {_SEC} AS published_us FROM {_I}")
def parsed_rss(spark, d):
    """A8."""
    i = _items(spark, d)
    item = F.concat(F.lit("<item>"), _text("title", F.col("t")), _text("link", F.concat(_key("https://a.example//x/"), F.lit("/?utm_source=feed#top"))), _text("guid", F.col("record_id")), _text("description", F.col("s")), _text("pubDate", _rfc("collected_at")), F.lit("</item>"))
    body = F.concat(F.lit("<rss version='2.0'><channel><title>F</title>"), item, F.lit("<item><title>without a link</title></item></channel></rss>"))
    return feeds.rss(_payloads(i, body)).select("source_id", "external_id", F.col("canonical_url").alias("url"), "title", "summary", _us("published_at").alias("published_us"))


_AX = "'2401.' || lpad(CAST(doc_id % 90000 AS VARCHAR), 5, '0')"


def _papers(spark, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), "added_at")
    return doc.withColumn("ax", F.concat(F.lit("2401."), F.lpad((F.col("doc_id") % 90000).cast("string"), 5, "0"))).where("doc_id < 90000")


@query(f"SELECT coalesce(source, '') AS source_id, {_AX} AS external_id, 'https://arxiv.org/abs/' || {_AX} || 'v2' AS url, '2' AS version, 'https://github.com/o/' || doc_id AS code_url, epoch_us(date_trunc('second', added_at)) AS published_us FROM documents WHERE doc_id < 90000")
def parsed_preprints(spark, d):
    """Of two versions in one answer the greater."""
    p = _papers(spark, d)
    link = F.concat(F.lit("<link rel='related' href='https://github.com/o/"), F.col("doc_id").cast("string"), F.lit("'/>"))
    entry = lambda v: F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), F.col("ax"), F.lit(f"v{v}</id><title>A title</title><summary>S</summary>"), _text("published", _iso("added_at")), F.lit(f"<link rel='alternate' href='http://arxiv.org/abs/"), F.col("ax"), F.lit(f"v{v}'/>"), link, F.lit("<author><name>Ann Lee</name></author></entry>"))
    body = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>q</title>"), entry(2), entry(1), F.lit("</feed>"))
    got = feeds.preprint_atom(_payloads(p, body))
    return got.select("source_id", "external_id", F.regexp_replace("canonical_url", "^http:", "https:").alias("url"), F.col("metadata.version").alias("version"), F.col("metadata.code_url").alias("code_url"), _us("published_at").alias("published_us"))


@query(f"SELECT coalesce(source, '') AS source_id, {_AX} AS external_id, 'https://arxiv.org/abs/' || {_AX} || 'v2' AS url, '2' AS version, 2 AS authors, 'https://github.com/o/' || doc_id AS code_url, epoch_us(date_trunc('second', added_at)) AS updated_us FROM documents WHERE doc_id < 90000 AND doc_id % 7 <> 0")
def parsed_harvest(spark, d):
    """A3, A4: the latest version with its history; deleted records are left out."""
    p = _papers(spark, d)
    version = lambda v, at: F.concat(F.lit(f"<version version='v{v}'><date>"), at, F.lit("</date><size>1kb</size></version>"))
    raw = F.concat(F.lit("<arXivRaw><id>"), F.col("ax"), F.lit("</id>"), version(1, F.lit("Mon, 01 Jan 2018 00:00:00 GMT")), version(2, _rfc("added_at")), F.lit("<title>T</title><authors>Ann Lee and Bo Ray</authors><categories>cs.AI</categories><abstract>See https://github.com/o/"), F.col("doc_id").cast("string"), F.lit("). End</abstract></arXivRaw>"))
    status = F.when(F.col("doc_id") % 7 == 0, " status='deleted'").otherwise("")
    body = F.concat(F.lit("<OAI-PMH><ListRecords><record><header"), status, F.lit("><identifier>oai</identifier><datestamp>2024-01-01</datestamp></header><metadata>"), raw, F.lit("</metadata></record></ListRecords></OAI-PMH>"))
    got = feeds.harvest(_payloads(p, body))
    return got.select("source_id", "external_id", F.col("canonical_url").alias("url"), F.col("metadata.version").alias("version"), F.size("authors").alias("authors"), F.col("metadata.code_url").alias("code_url"), _us("updated_at").alias("updated_us"))


@query(f"SELECT source_id, record_id AS external_id, t AS title, 'camera_ready' AS acceptance, epoch_us(date_trunc('millisecond', collected_at)) AS published_us FROM {_I} WHERE t <> '' AND ({_TERMS})")
def parsed_notes(spark, d):
    """Wrapped values; notes on the frontier."""
    i = _items(spark, d)
    wrap = lambda c: F.struct(F.col(c).alias("value"))
    note = F.struct(F.col("record_id").alias("id"), F.struct(wrap("t").alias("title"), wrap("s").alias("abstract")).alias("content"), F.unix_millis(F.col("collected_at").cast("timestamp")).alias("pdate"), F.array(F.lit("V/-/Camera_Ready_Revision")).alias("invitations"))
    got = apis.conference_notes(_payloads(i, F.to_json(F.struct(F.array(note, note).alias("notes")))))
    return got.select("source_id", "external_id", "title", F.col("metadata.acceptance_status").alias("acceptance"), _us("published_at").alias("published_us"))


@query(f"SELECT source_id, '2024.acl-long.' || CAST(regexp_replace(record_id, '[^0-9]', '', 'g') AS BIGINT) AS external_id, a AS title, b AS summary FROM {_I} WHERE a <> '' AND ({_TERMS.replace('lower(t || chr(10) || s)', 'lower(a || chr(10) || b)')})")
def parsed_anthology(spark, d):
    """Titles by anchor, abstracts by the paper named in their id."""
    i = _items(spark, d).where("a <> ''").withColumn("n", F.regexp_replace("record_id", "[^0-9]", "").cast("bigint").cast("string"))
    body = F.concat(F.lit("<p><a href='/2024.acl-long."), F.col("n"), F.lit("/'>"), escape_xml(F.col("a")), F.lit("</a></p><div id='abstract-2024--acl-long--"), F.col("n"), F.lit("' class='card'><div class='card-body p-3'>"), escape_xml(F.col("b")), F.lit("</div></div>"))
    return pages.anthology_events(_payloads(i, body)).select("source_id", "external_id", "title", "summary")


@query(f"SELECT source_id, record_id AS external_id, 'camera_ready' AS acceptance FROM {_I} WHERE {_TERMS}")
def parsed_proceedings(spark, d):
    """A7, C19."""
    i = _items(spark, d)
    item = F.concat(F.lit("<item>"), _text("title", F.col("t")), _text("link", _key("https://p.example/")), _text("guid", F.col("record_id")), _text("description", F.col("s")), F.lit("</item>"))
    got = feeds.proceedings(_payloads(i, F.concat(F.lit("<rss><channel><title>P</title>"), item, F.lit("</channel></rss>"))))
    return got.select("source_id", "external_id", F.col("metadata.acceptance_status").alias("acceptance"))


@query(f"SELECT source_id, 'https://m.example/news/' || record_id || '-story' AS url, sha256('https://m.example/news/' || record_id || '-story') AS external_id, {_SEC} AS updated_us FROM {_I}")
def parsed_sitemap(spark, d):
    """Addresses by pattern; ids are hashes of the address."""
    i = _items(spark, d)
    page = F.concat(F.lit("<url>"), _text("loc", F.concat(_key("https://m.example/news/"), F.lit("-story/"))), _text("lastmod", _iso("collected_at")), F.lit("</url>"))
    body = F.concat(F.lit("<urlset>"), page, F.lit("<url><loc>https://m.example/about-us</loc></url><url><loc>https://m.example/news/abc</loc></url></urlset>"))
    return feeds.sitemap(_payloads(i, body), ["/news/"]).select("source_id", F.col("canonical_url").alias("url"), "external_id", _us("updated_at").alias("updated_us"))


@query(f"SELECT source_id, record_id AS external_id, CASE WHEN t <> '' THEN t ELSE 'v1' END AS title, {_SEC} AS published_us FROM {_I}")
def parsed_releases(spark, d):
    """A10: drafts are left out; name, else tag."""
    i = _items(spark, d)
    one = lambda draft: F.struct(F.concat(F.col("record_id"), F.lit("-d" if draft else "")).alias("id"), F.lit("v1").alias("tag_name"), F.col("t").alias("name"), F.col("s").alias("body"), F.lit(draft).alias("draft"), _key("https://g.example/r/").alias("html_url"), _iso("collected_at").alias("published_at"))
    got = apis.releases(_payloads(i, F.to_json(F.array(one(True), one(False)))))
    return got.select("source_id", "external_id", "title", _us("published_at").alias("published_us"))


@query(f"SELECT source_id, 'org/' || record_id AS external_id, 'https://huggingface.co/datasets/org/' || record_id AS url, 'dataset' AS repo_type, {_SEC} AS updated_us FROM {_I}")
def parsed_models(spark, d):
    """A11."""
    i = _items(spark, d)
    body = F.to_json(F.array(F.struct(_key("org/").alias("id"), F.lit("text").alias("pipeline_tag"), _iso("collected_at").alias("lastModified"), F.lit(3).alias("likes"))))
    got = apis.models(_payloads(i, body), "dataset")
    return got.select("source_id", "external_id", F.col("canonical_url").alias("url"), F.col("metadata.repo_type").alias("repo_type"), _us("updated_at").alias("updated_us"))


@query(f"SELECT source_id, a AS title, 'https://site.example/news/' || record_id AS url, sha256('https://site.example/news/' || record_id) AS external_id FROM {_I} WHERE length(a) >= 4")
def parsed_listing(spark, d):
    """Links of a page to its own site, each once."""
    i = _items(spark, d)
    a = F.concat(F.lit("<a href='/news/"), F.col("record_id"), F.lit("'><b>"), escape_xml(F.col("a")), F.lit("</b></a>"))
    body = F.concat(F.lit("<nav><a href='#x'>Within</a><a href='https://other.example/news/1'>Elsewhere</a></nav>"), a, F.replace(a, F.lit("'>"), F.lit("?ref=again'>")), F.lit("<a href='/about'>About us</a>"))
    return pages.listing(_payloads(i, body), include_urls=["/news/"], max_items=1 << 30).select("source_id", "title", F.col("canonical_url").alias("url"), "external_id")


@query(f"SELECT source_id, 'https://site.example/c/' || record_id AS url, CASE WHEN a <> '' THEN a ELSE 'Site' END AS title, 'Text of ' || record_id AS content, {_SEC} AS published_us FROM {_I}")
def parsed_articles(spark, d):
    """Structured data before meta tags; text inside the article only; the address on the page's own site."""
    i = _items(spark, d)
    ld = F.to_json(F.struct(F.array(F.struct(F.lit("NewsArticle").alias("@type"), F.nullif("a", F.lit("")).alias("headline"), _key("https://site.example/c/").alias("url"), _iso("collected_at").alias("datePublished"))).alias("@graph")))
    body = F.concat(F.lit("<head><title>Site</title><script type='application/ld+json'>"), F.replace(ld, F.lit("<"), F.lit("\\u003c")), F.lit("</script></head><nav>Menu</nav><article><header>Head</header><p>Text of "), F.col("record_id"), F.lit("</p><aside>Ad</aside></article><p>After</p>"))
    return pages.articles(_payloads(i, body)).select("source_id", F.col("canonical_url").alias("url"), "title", "content", _us("published_at").alias("published_us"))


@query("SELECT coalesce(source_id, '') AS source_id, record_id AS external_id, 'ACME · 10-K · ' || strftime(collected_at, '%Y-%m-%d') AS title, 'https://www.sec.gov/Archives/edgar/data/123/' || replace(record_id, '-', '') || '/d.htm' AS url, 'false' AS routine FROM collected_items WHERE collected_at::DATE >= (SELECT max(collected_at)::DATE FROM collected_items) - 3659")
def parsed_filings(spark, d):
    """Column-wise arrays zipped; followed forms only; up to the lookback."""
    i = _items(spark, d)
    today = i.agg(F.to_date(F.max("collected_at"))).first()[0]
    day = F.date_format("collected_at", "yyyy-MM-dd")
    two = lambda a, b: F.array(a, b)
    recent = F.struct(two(F.col("record_id"), _key("x")).alias("accessionNumber"), two(day, day).alias("filingDate"), two(F.lit("10-K"), F.lit("6-K/A")).alias("form"), two(F.lit("d.htm"), F.lit("e.htm")).alias("primaryDocument"))
    body = F.to_json(F.struct(F.lit("0000000123").alias("cik"), F.lit("ACME").alias("name"), F.struct(recent.alias("recent")).alias("filings")))
    # one answer a filing: each is a source of its own here, so that a too old one ends its own listing only
    p = _payloads(i, body).withColumn("source_id", F.concat("source_id", F.lit("|"), F.get_json_object("body", "$.filings.recent.accessionNumber[0]")))
    got = apis.filings(p, F.lit(today), 3660)
    return got.select(F.split_part("source_id", F.lit("|"), F.lit(1)).alias("source_id"), "external_id", "title", F.col("canonical_url").alias("url"), F.col("metadata.routine").alias("routine"))


@query(f"SELECT source_id, record_id AS external_id, 'N (600000) · ' || t AS title, epoch_us(collected_at::DATE::TIMESTAMP) - 28800000000 AS published_us FROM {_I} WHERE t <> ''")
def parsed_exchange(spark, d):
    """Own code, documents of one folder, local days of Shanghai."""
    i = _items(spark, d)
    row = lambda code, folder: F.struct(F.lit(code).alias("SECURITY_CODE"), F.lit("N").alias("SECURITY_NAME"), F.col("t").alias("TITLE"), F.concat(F.lit(folder), F.col("record_id"), F.lit(".pdf")).alias("URL"), F.date_format("collected_at", "yyyy-MM-dd").alias("SSEDATE"))
    fine = "/disclosure/listedinfo/announcement/c/"
    p = _payloads(i, F.to_json(F.struct(F.array(row("600000", fine), row("600000", fine), row("600001", fine), row("600000", "/other/")).alias("result"))))
    codes = p.select("source_id").distinct().withColumn("code", F.lit("600000"))
    return apis.exchange_announcements(p, codes).select("source_id", "external_id", "title", _us("published_at").alias("published_us"))


@query(f"SELECT source_id, record_id AS external_id, 'N · ' || t AS title, 'https://static.cninfo.com.cn/finalpage/2024/' || record_id || '.PDF' AS url, epoch_us(date_trunc('millisecond', collected_at)) AS published_us FROM {_I} WHERE t <> '' AND NOT regexp_matches(t, '(?i)</?em\\b')")
def parsed_disclosures(spark, d):
    """Highlight tags stripped, allowed paths only."""
    i = _items(spark, d).where(~F.col("t").rlike(r"(?i)</?em\b"))
    row = lambda stem, suffix: F.struct(F.concat(F.col("record_id"), F.lit(suffix)).alias("announcementId"), F.concat(F.lit("<em>"), F.col("t"), F.lit("</em>")).alias("announcementTitle"), F.concat(F.lit(stem), F.col("record_id"), F.lit(".PDF")).alias("adjunctUrl"), F.unix_millis(F.col("collected_at").cast("timestamp")).alias("announcementTime"), F.lit("N").alias("secName"))
    got = apis.disclosure_announcements(_payloads(i.where("t <> ''"), F.to_json(F.struct(F.array(row("finalpage/2024/", ""), row("//evil/", "x")).alias("announcements")))))
    return got.select("source_id", "external_id", "title", F.col("canonical_url").alias("url"), _us("published_at").alias("published_us"))


@query(f"SELECT source_id, 'STD-' || lpad(record_id, 12, '0') AS external_id, 'GB 1 · ' || t AS title, 'a, b' AS terms FROM {_I} WHERE t <> '' AND NOT contains(t, '<')")
def parsed_standards(spark, d):
    """One record an id, the union of the terms that found it."""
    i = _items(spark, d).where(~F.col("t").contains("<")).withColumn("term", F.explode(F.array(F.lit("b"), F.lit("a"))))
    row = F.struct(F.concat(F.lit("STD-"), F.lpad("record_id", 12, "0")).alias("id"), F.col("t").alias("C_C_NAME"), F.lit("GB 1").alias("C_STD_CODE"))
    got = apis.standards(_payloads(i, F.to_json(F.struct(F.array(row).alias("rows"))), "term"))
    return got.select("source_id", "external_id", "title", F.col("metadata.matched_terms").alias("terms"))


@query("SELECT record_id, CASE WHEN collected_at IS NULL THEN NULL ELSE record_id END AS id FROM collected_items")
def event_stream_payloads(spark, d):
    """The last data line of an event stream; anything but an object gives null."""
    i = table(spark, d, "collected_items").select("record_id", "collected_at")
    data = F.concat(F.lit("event: m\ndata: {\"id\": \"first\"}\n\ndata: {\"id\": \""), F.col("record_id"), F.lit("\"}\n\n"))
    body = F.when(F.col("collected_at").isNull(), "data: [1]").otherwise(data)
    return i.select("record_id", F.get_json_object(apis.last_event_data(body), "$.id").alias("id"))
