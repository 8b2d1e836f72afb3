"""XML sources: syndication feeds, preprint feeds, harvest records, sitemaps, proceedings volumes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import arxiv_identity, canonical_url, stable_id
from tidemark.functions.text import slug_title
from tidemark.sources.contract import instant, metadata, records

# Fixed values in this module: element names of the feeds, stems of their addresses, patterns of code addresses and of what parts authors.
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"}
_ITEM = "title string, link string, guid string, description string, encoded string, pubDate string, creator array<string>, author array<string>"
_LINK = "struct<_href string, _rel string, _title string, _type string>"
_ENTRY = f"id string, title string, summary string, content string, published string, updated string, author array<struct<name string>>, link array<{_LINK}>, category array<struct<_term string>>"

# Terms by which a proceedings entry counts as being on the frontier.
FRONTIER_TERMS = (
    "agent", "language model", "llm", "tool use", "computer use", "planning", "memory", "self-training", "self-play", "self-improv", "synthetic data",
    "rlvr", "rlaif", "recursive", "interpretability", "circuit", "activation", "model internals", "safety", "alignment", "oversight", "red team",
    "governance", "prompt injection", "long-horizon", "long horizon", "multi-agent", "autonomous",
)


def _ddl(fields: str) -> str:
    """``name type`` fields as ``name: type`` inside a struct."""
    import re

    return re.sub(r"(\b[_A-Za-z]\w*) (string|array|struct)", r"\1: \2", fields)


def on_frontier(title: Column, text: Column) -> Column:
    """Whether a title or text holds any frontier term."""
    hay = F.lower(F.concat_ws("\n", title, text))
    hit = F.lit(False)
    for t in FRONTIER_TERMS:
        hit = hit | hay.contains(t)
    return hit


def rss(payloads: DataFrame, max_items: int = 500) -> DataFrame:
    """The first ``max_items`` entries with a link of each feed, in either syntax; the id is the feed's own, else the hash of the link."""
    atom = f"struct<id: string, title: string, summary: string, content: string, published: string, updated: string, author: array<struct<name: string>>, link: array<{_ddl(_LINK)}>>"
    item = f"struct<{_ddl(_ITEM)}>"
    schema = f"struct<title: string, entry: array<{atom}>, item: array<{item}>, channel: struct<title: string, description: string, item: array<{item}>>>"
    doc = payloads.select("source_id", F.from_xml("body", schema, _XML).alias("d"))
    links = lambda e: F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    row = lambda **c: F.struct(*[v.cast("array<string>" if n == "authors" else "string").alias(n) for n, v in c.items()])
    of_item = lambda e: row(id=e["guid"], link=e["link"], title=e["title"], summary=e["description"], content=e["encoded"], authors=F.coalesce(e["creator"], e["author"]), published=e["pubDate"], updated=F.lit(None))
    of_entry = lambda e: row(id=e["id"], link=F.get(links(e), F.lit(0))["_href"], title=e["title"], summary=e["summary"], content=e["content"], authors=F.transform(e["author"], lambda a: a["name"]), published=e["published"], updated=e["updated"])
    entries = F.coalesce(F.transform("d.channel.item", of_item), F.transform("d.item", of_item), F.transform("d.entry", of_entry))
    e = doc.select("source_id", F.coalesce("d.channel.title", "d.title").alias("feed"), F.posexplode(entries).alias("pos", "e")).where(F.col("pos") < max_items)
    url = canonical_url(F.col("e.link"))
    return records(
        e.where("e.link is not null and e.link <> ''"),
        external_id=F.coalesce(F.nullif(F.trim("e.id"), F.lit("")), stable_id(url)), canonical_url=F.col("e.link"), title=F.coalesce("e.title", F.lit("")), summary=F.col("e.summary"),
        content=F.col("e.content"), authors=F.col("e.authors"), published_at=instant(F.col("e.published")), updated_at=instant(F.col("e.updated")), metadata=metadata(feed_title=F.col("feed")),
    )


def _entries(payloads: DataFrame) -> DataFrame:
    schema = f"struct<title: string, entry: array<struct<{_ddl(_ENTRY)}>>>"
    doc = payloads.select("source_id", F.from_xml("body", schema, _XML).alias("d"))
    return doc.select("source_id", F.posexplode("d.entry").alias("pos", "e"))


def preprint_atom(payloads: DataFrame) -> DataFrame:
    """Preprint entries: identifier and version from the id, one record an identifier, the highest version (A1, A2)."""
    e = _entries(payloads).withColumn("aid", arxiv_identity(F.coalesce("e.id", F.col("e.link")[0]["_href"]))).where("aid is not null")
    # of equal versions the first entry stays
    best = e.groupBy("source_id", F.col("aid.id").alias("k")).agg(F.max_by(F.struct("e", "aid"), F.struct(F.col("aid.version"), -F.col("pos"))).alias("x")).select("source_id", "x.e", "x.aid")
    links = F.coalesce("e.link", F.array().cast(f"array<{_ddl(_LINK).replace('struct<_href', 'struct<_href')}>"))
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    code = F.filter(links, lambda x: x["_href"].contains("github.com") | x["_href"].contains("gitlab.com"))
    fallback = F.concat(F.lit("https://arxiv.org/abs/"), F.col("aid.id"), F.lit("v"), F.col("aid.version"))
    return records(
        best,
        external_id=F.col("aid.id"), canonical_url=F.coalesce(F.get(alternate, F.lit(0))["_href"], fallback), title=F.coalesce("e.title", F.lit("")), summary=F.col("e.summary"),
        authors=F.col("e.author.name"), published_at=instant(F.col("e.published")), updated_at=instant(F.col("e.updated")),
        metadata=metadata(version=F.col("aid.version"), categories=F.array_join("e.category._term", " "), code_url=F.get(code, F.lit(0))["_href"]),
    )


def harvest(payloads: DataFrame) -> DataFrame:
    """Harvested records: deleted ones skipped, the latest version kept with its history, one record an identifier (A3, A4)."""
    raw = "id string, title string, authors string, categories string, comments string, abstract string, doi string, version array<struct<_version string, date string, size string>>"
    record = f"header struct<_status string, identifier string, datestamp string>, metadata struct<arXivRaw struct<{raw}>>"
    schema = f"struct<ListRecords: struct<record: array<struct<{_ddl(record)}>>>>"
    doc = payloads.select("source_id", F.from_xml("body", schema, _XML).alias("d"))
    r = doc.select("source_id", F.posexplode("d.ListRecords.record").alias("pos", "r")).where("coalesce(r.header._status, '') <> 'deleted'").select("source_id", "pos", "r.header", F.col("r.metadata.arXivRaw").alias("a"))
    r = r.where("a.id is not null and size(a.version) > 0").withColumn("last", F.element_at("a.version", -1))
    number = F.coalesce(F.nullif(F.regexp_extract("last._version", r"(\d+)", 1), F.lit("")).cast("int"), F.size("a.version"))
    r = r.withColumn("n", number).groupBy("source_id", F.trim("a.id").alias("k")).agg(F.max_by(F.struct("a", "last", "n", "header"), F.struct("n", -F.col("pos"))).alias("x")).select("source_id", "k", "x.*")
    text = F.concat_ws("\n", "a.abstract", "a.comments")
    code = F.nullif(F.regexp_replace(F.regexp_extract(text, r"(https?://(?:www\.)?(?:github\.com|gitlab\.com)/[^\s<>]+)", 1), r"[.,);\]]+$", ""), F.lit(""))
    names = F.filter(F.transform(F.split("a.authors", r",|\band\b"), lambda x: F.trim(x)), lambda x: x != "")
    history = F.array_join(F.transform("a.version", lambda v: F.concat_ws("@", v["_version"], v["date"])), "; ")
    return records(
        r,
        external_id=F.col("k"), canonical_url=F.concat(F.lit("https://arxiv.org/abs/"), F.col("k"), F.lit("v"), F.col("n")), title=F.trim("a.title"), summary=F.trim("a.abstract"), authors=names,
        published_at=instant(F.col("a.version")[0]["date"]), updated_at=instant(F.col("last.date")),
        metadata=metadata(version=F.col("n"), version_history=history, categories=F.col("a.categories"), comments=F.col("a.comments"), doi=F.col("a.doi"), datestamp=F.col("header.datestamp"), code_url=code),
    )


def sitemap(payloads: DataFrame, patterns: list[str], max_items: int = 100) -> DataFrame:
    """Pages of a sitemap whose address fits a pattern and whose slug makes a title of four letters or more."""
    doc = payloads.select("source_id", "url", F.from_xml("body", "struct<url: array<struct<loc: string, lastmod: string>>>", _XML).alias("d"))
    u = doc.select("source_id", F.col("url").alias("map"), F.posexplode("d.url").alias("pos", "u")).withColumn("c", canonical_url(F.col("u.loc")))
    fits = F.col("c").rlike("(?i)(" + "|".join(patterns) + ")") if patterns else F.lit(True)
    u = u.withColumn("title", slug_title(F.col("c"))).where(F.col("c").rlike("^https?://") & fits & (F.length("title") >= 4))
    u = u.withColumn("k", F.row_number().over(Window.partitionBy("source_id", "map").orderBy("pos"))).where(F.col("k") <= max_items)
    return records(u, external_id=stable_id(F.col("c")), canonical_url=F.col("c"), title=F.col("title"), updated_at=instant(F.col("u.lastmod")), metadata=metadata(discovery_only=F.lit("true"), sitemap_url=F.col("map")))


def volumes(index_pages: DataFrame, top: int = 6) -> DataFrame:
    """(source_id, volume): the highest volume numbers that an index page links to."""
    ids = index_pages.select("source_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"""(?i)href=["']?/?v(\d+)/?"""), 1))).alias("v")).select("source_id", F.col("v").cast("int").alias("volume")).distinct()
    return ids.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("volume")))).where(F.col("k") <= top).drop("k")


def proceedings(payloads: DataFrame) -> DataFrame:
    """Entries of proceedings feeds that are on the frontier."""
    r = rss(payloads)
    return r.where(on_frontier(F.col("title"), F.col("summary"))).withColumn("metadata", F.map_concat("metadata", metadata(acceptance_status=F.lit("camera_ready"))))


def feed_warnings(payloads: DataFrame, root: str = "channel") -> DataFrame:
    """(source_id, malformed): payloads that don't parse (A26); their rows are not in the records."""
    parsed = F.from_xml("body", f"struct<_corrupt_record: string, {root}: string>", {**_XML, "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = F.col("body").isNull() | (F.trim("body") == "") | F.coalesce(parsed["_corrupt_record"].isNotNull(), F.lit(True))
    return payloads.groupBy("source_id").agg(F.count_if(bad).alias("malformed"))
