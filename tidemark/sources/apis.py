"""JSON sources: conference notes, releases, model cards, filings, exchange announcements, standards. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.contract import first_of, instant, metadata, millis, records
from tidemark.sources.feeds import on_frontier

# Fixed values in this module: field names of the services' answers, stems of their addresses, form codes, the shape of a standard's id.
# Filing forms that are followed, and those of them that are routine.
FORMS = ("8-K", "8-K/A", "10-Q", "10-Q/A", "10-K", "10-K/A", "S-1", "S-1/A", "F-1", "F-1/A", "6-K", "20-F", "20-F/A", "4", "4/A", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A")
ROUTINE_FORMS = ("4", "4/A", "SC 13G", "SC 13G/A")


def _value(json: Column, path: str) -> Column:
    """A field that is either a plain value or {"value": ...}."""
    return F.coalesce(F.get_json_object(json, f"$.{path}.value"), F.get_json_object(json, f"$.{path}"))


def _strings(json: Column) -> Column:
    """A JSON array of texts; a single text makes an array of one."""
    return F.coalesce(F.from_json(json, "array<string>"), F.when(json.isNotNull(), F.array(json)))


def conference_notes(payloads: DataFrame) -> DataFrame:
    """Notes with a title, on the frontier; wrapped values unwrapped; camera-ready by invitation (A5)."""
    n = payloads.select("source_id", "fetched_at", "url", F.posexplode(F.from_json("body", "struct<notes: array<string>>")["notes"]).alias("pos", "n"))
    n = first_of(n, F.get_json_object("n", "$.id"), "fetched_at", "url", "pos")
    g = lambda p: F.get_json_object("n", f"$.{p}")
    c = n.select("source_id", "n", g("id").alias("id"), F.trim(F.regexp_replace(_value(F.col("n"), "content.title"), r"\s+", " ")).alias("title"), _value(F.col("n"), "content.abstract").alias("abstract"))
    c = c.where((F.coalesce("title", F.lit("")) != "") & on_frontier(F.col("title"), F.col("abstract")))
    ready = F.coalesce(g("invitations").contains("Camera_Ready"), F.lit(False))
    revised = F.coalesce(g("mdate"), g("tmdate"))
    return records(
        c,
        external_id=F.col("id"), canonical_url=F.concat(F.lit("https://openreview.net/forum?id="), F.col("id")), title=F.col("title"), summary=F.col("abstract"),
        authors=_strings(_value(F.col("n"), "content.authors")), published_at=millis(F.coalesce(g("pdate"), g("odate"))), updated_at=millis(revised),
        metadata=metadata(acceptance_status=F.when(ready, "camera_ready").otherwise("accepted"), revision=revised, venue=_value(F.col("n"), "content.venue")),
    )


def releases(payloads: DataFrame) -> DataFrame:
    """Releases that are no drafts: id else tag, name else tag else id (A10)."""
    schema = "array<struct<id: string, tag_name: string, name: string, body: string, draft: boolean, prerelease: boolean, html_url: string, published_at: string, updated_at: string, author: struct<login: string>>>"
    r = payloads.select("source_id", F.explode(F.from_json("body", schema)).alias("r")).where("not coalesce(r.draft, false)")
    some = lambda n: F.nullif(F.col(f"r.{n}"), F.lit(""))
    key = F.coalesce(some("id"), some("tag_name"))
    return records(
        r, external_id=key, canonical_url=F.col("r.html_url"), title=F.coalesce(some("name"), some("tag_name"), key), summary=F.col("r.body"), published_at=instant(F.col("r.published_at")),
        updated_at=instant(F.col("r.updated_at")), metadata=metadata(tag_name=F.col("r.tag_name"), prerelease=F.coalesce("r.prerelease", F.lit(False)), author=F.col("r.author.login")),
    )


def models(payloads: DataFrame, kind: str = "model") -> DataFrame:
    """Models or datasets of a hub's list."""
    schema = "array<struct<modelId: string, id: string, pipeline_tag: string, lastModified: string, downloads: bigint, likes: bigint, sha: string, tags: array<string>>>"
    m = payloads.select("source_id", F.explode(F.from_json("body", schema)).alias("m")).withColumn("k", F.coalesce(F.nullif("m.modelId", F.lit("")), F.nullif("m.id", F.lit(""))))
    base = "https://huggingface.co/datasets/" if kind == "dataset" else "https://huggingface.co/"
    return records(
        m, external_id=F.col("k"), canonical_url=F.concat(F.lit(base), F.col("k")), title=F.col("k"), summary=F.col("m.pipeline_tag"), updated_at=instant(F.col("m.lastModified")),
        metadata=metadata(downloads=F.col("m.downloads"), likes=F.col("m.likes"), sha=F.col("m.sha"), tags=F.array_join("m.tags", " "), repo_type=F.lit(kind)),
    )


def filings(payloads: DataFrame, today: Column, lookback_days: int = 45, last_seen: DataFrame | None = None) -> DataFrame:
    """Filings of column-wise arrays, newest first, up to the last one seen or the lookback date.

    ``last_seen``: source_id, external_id. The arrays are zipped by position; the stop is the first position that is
    known or too old; only followed forms are kept.
    """
    names = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument", "primaryDocDescription", "items", "acceptanceDateTime")
    schema = "struct<cik: string, name: string, filings: struct<recent: struct<" + ", ".join(f"{n}: array<string>" for n in names) + ">>>"
    d = payloads.select("source_id", F.from_json("body", schema).alias("d"))
    r = d.select("source_id", F.regexp_replace("d.cik", "^0+", "").alias("cik"), F.col("d.name").alias("company"), F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"d.filings.recent.{n}"), F.array().cast("array<string>")).alias(n) for n in names])).alias("pos", "f"))
    r = r.withColumn("acc", F.trim("f.accessionNumber")).withColumn("filed", F.to_date(instant(F.col("f.filingDate"))))
    if last_seen is not None:
        r = r.join(last_seen.select("source_id", F.col("external_id").alias("seen")), "source_id", "left")
    else:
        r = r.withColumn("seen", F.lit(None).cast("string"))
    cutoff = F.date_sub(today, max(1, min(lookback_days, 3660)) - 1)
    end = r.groupBy("source_id").agg(F.min(F.when((F.col("acc") == F.col("seen")) | (F.col("filed") < cutoff), F.col("pos"))).alias("end"))
    form = F.coalesce("f.form", F.lit(""))
    kept = r.join(end, "source_id").where((F.col("end").isNull() | (F.col("pos") < F.col("end"))) & (form.isin(*FORMS) | form.startswith("424B")))
    folder = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik"), F.lit("/"), F.regexp_replace("acc", "-", ""))
    doc = F.nullif("f.primaryDocument", F.lit(""))
    return records(
        kept,
        external_id=F.col("acc"), canonical_url=F.concat(folder, F.coalesce(F.concat(F.lit("/"), doc), F.lit(""))), title=F.concat_ws(" · ", "company", form, "f.filingDate"),
        summary=F.array_join(F.filter(F.array("f.primaryDocDescription", "f.items"), lambda x: F.coalesce(x, F.lit("")) != ""), " · "), published_at=instant(F.col("f.filingDate")), updated_at=instant(F.col("f.acceptanceDateTime")),
        metadata=metadata(accession_number=F.col("acc"), form=form, filing_date=F.col("f.filingDate"), report_date=F.col("f.reportDate"), routine=form.isin(*ROUTINE_FORMS)),
    )


def detail_candidates(parsed: DataFrame, k: int = 5) -> DataFrame:
    """The newest records of each source that aren't routine: those whose documents are worth fetching."""
    from tidemark.operators.relations import top_per_key

    when = F.coalesce("updated_at", "published_at")
    return top_per_key(parsed.where(F.coalesce(F.col("metadata")["routine"], F.lit("false")) != "true"), ["source_id"], [when.desc_nulls_last(), F.desc("external_id")], k)


def exchange_announcements(payloads: DataFrame, codes: DataFrame, routine: list[str] | None = None) -> DataFrame:
    """Announcements of a security: own code only, documents under the announcement folder, local time of Shanghai.

    ``codes``: source_id, code. Pages of one listing may repeat a document; the first stays.
    """
    row = "SECURITY_CODE: string, SECURITY_NAME: string, TITLE: string, URL: string, BULLETIN_HEADING: string, BULLETIN_TYPE: string, SSEDATE: string, ADDDATE: string"
    d = payloads.select("source_id", "fetched_at", "url", F.from_json("body", f"struct<result: array<struct<{row}>>, pageHelp: struct<data: array<struct<{row}>>>>").alias("d"))
    r = d.select("source_id", "fetched_at", "url", F.posexplode(F.coalesce("d.result", "d.pageHelp.data")).alias("pos", "r")).join(codes, "source_id")
    code = F.coalesce(F.nullif(F.trim("r.SECURITY_CODE"), F.lit("")), F.col("code"))
    path = F.regexp_replace(F.regexp_replace(F.trim("r.URL"), r"(?i)^https?://(www\.)?sse\.com\.cn", ""), r"[?#].*$", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    fine = (code == F.col("code")) & F.col("code").rlike(r"^\d{6}$") & path.startswith("/disclosure/listedinfo/announcement/") & ~path.contains("..") & path.rlike(r"(?i)\.pdf$") & (F.coalesce(F.trim("r.TITLE"), F.lit("")) != "")
    kept = r.where(fine).withColumn("p", path).withColumn("doc", F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.pdf$", ""))
    kept = first_of(kept, F.col("doc"), "fetched_at", "url", "pos")
    title = F.trim("r.TITLE")
    is_routine = title.rlike("(?i)(" + "|".join(routine) + ")") if routine else F.lit(False)
    return records(
        kept,
        external_id=F.col("doc"), canonical_url=F.concat(F.lit("https://www.sse.com.cn"), F.col("p")),
        title=F.concat(F.coalesce(F.nullif(F.trim("r.SECURITY_NAME"), F.lit("")), F.col("source_id")), F.lit(" ("), F.col("code"), F.lit(") · "), title),
        summary=F.array_join(F.array_distinct(F.filter(F.array("r.BULLETIN_HEADING", "r.BULLETIN_TYPE"), lambda x: F.coalesce(x, F.lit("")) != "")), " · "),
        published_at=instant(F.col("r.SSEDATE"), "Asia/Shanghai"), updated_at=instant(F.col("r.ADDDATE"), "Asia/Shanghai"), metadata=metadata(ticker=F.col("code"), routine=is_routine, filing_date=F.col("r.SSEDATE")),
    )


def disclosure_announcements(payloads: DataFrame, routine: list[str] | None = None) -> DataFrame:
    """Announcements of a disclosure service: highlight tags stripped, documents under an allowed folder."""
    row = "announcementId: string, announcementTitle: string, adjunctUrl: string, announcementTime: string, secName: string, secCode: string, orgId: string, announcementTypeName: string"
    r = payloads.select("source_id", "fetched_at", "url", F.posexplode(F.from_json("body", f"struct<announcements: array<struct<{row}>>>")["announcements"]).alias("pos", "r"))
    title = F.trim(F.regexp_replace("r.announcementTitle", r"(?i)</?em\b[^>]*>", ""))
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.replace(F.trim("r.adjunctUrl"), F.lit("\\"), F.lit("/")), r"[?#].*$", ""), "^/", ""))
    fine = (F.coalesce(title, F.lit("")) != "") & ~F.col("r.adjunctUrl").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)") & path.rlike(r"(?i)^/finalpage/.*\.pdf$")
    is_routine = title.rlike("(?i)(" + "|".join(routine) + ")") if routine else F.lit(False)
    return records(
        first_of(r.where(fine), F.trim("r.announcementId"), "fetched_at", "url", "pos"), external_id=F.trim("r.announcementId"), canonical_url=F.concat(F.lit("https://static.cninfo.com.cn"), path), title=F.concat_ws(" · ", F.nullif(F.trim("r.secName"), F.lit("")), title),
        summary=F.col("r.announcementTypeName"), published_at=millis(F.col("r.announcementTime")), metadata=metadata(ticker=F.col("r.secCode"), org_id=F.col("r.orgId"), routine=is_routine),
    )


def overlap_window(watermark: Column, now: Column, lookback_days: int = 45, overlap_days: int = 7) -> Column:
    """The first day to ask for again: the watermark less an overlap, but no earlier than the lookback."""
    earliest = now - F.expr(f"INTERVAL {lookback_days} DAYS")
    again = F.least(now, watermark) - F.expr(f"INTERVAL {overlap_days} DAYS")
    return F.to_date(F.from_utc_timestamp(F.when(watermark.isNull(), earliest).otherwise(F.greatest(earliest, again)), "Asia/Shanghai"))


def standards(payloads: DataFrame) -> DataFrame:
    """Standards found under several search terms: one record an id, the union of its terms (A20). Payloads carry ``term``."""
    row = "id: string, C_C_NAME: string, C_STD_CODE: string, ISSUE_DATE: string, ACT_DATE: string, STD_NATURE: string, STATE: string"
    r = payloads.select("source_id", "term", F.explode(F.from_json("body", f"struct<rows: array<struct<{row}>>>")["rows"]).alias("r"))
    bare = lambda n: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(f"r.{n}", F.lit("")), "<[^>]*>", ""), r"\s+", " "))
    fine = F.trim("r.id").rlike("^[A-Za-z0-9_-]{8,128}$") & (bare("C_C_NAME") != "")
    g = r.where(fine).groupBy("source_id", F.trim("r.id").alias("id")).agg(F.min_by("r", "term").alias("r"), F.array_sort(F.collect_set("term")).alias("terms"))
    code = F.nullif(bare("C_STD_CODE"), F.lit(""))
    return records(
        g, external_id=F.col("id"), canonical_url=F.concat(F.lit("https://std.samr.gov.cn/gb/search/gbDetailed?id="), F.col("id")), title=F.concat_ws(" · ", code, bare("C_C_NAME")),
        summary=F.array_join(F.filter(F.array(bare("STD_NATURE"), bare("STATE"), bare("ISSUE_DATE"), bare("ACT_DATE")), lambda x: x != ""), "; "), published_at=instant(bare("ISSUE_DATE")),
        metadata=metadata(standard_code=code, state=F.nullif(bare("STATE"), F.lit("")), matched_terms=F.array_join("terms", ", ")),
    )


def last_event_data(body: Column) -> Column:
    """The JSON of an event stream's last data line, else of the body itself; null unless it is an object."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:"))
    text = F.trim(F.coalesce(F.substring(F.try_element_at(lines, F.lit(-1)), 6, 1 << 30), body))
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text)


def fenced_object(text: Column) -> Column:
    """The JSON object of a model's answer, without a code fence around it; null unless it is one."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    return F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare)


def watermark_after(parsed: DataFrame, current: DataFrame, overlap_hours: int = 12) -> DataFrame:
    """(source_id, watermark, ask_from): the newest time of each source's records, kept where it was later, and from when to ask next (A1).

    ``current``: source_id, watermark. Sources without new records keep theirs.
    """
    new = parsed.groupBy("source_id").agg(F.max(F.coalesce("updated_at", "published_at")).alias("__new"))
    both = current.select("source_id", F.col("watermark").alias("__old")).join(new, "source_id", "full")
    mark = F.greatest("__old", "__new")
    return both.select("source_id", mark.alias("watermark"), (mark - F.expr(f"INTERVAL {overlap_hours} HOURS")).alias("ask_from"))


def page_notices(pages: DataFrame, page_size: int, budget: int) -> DataFrame:
    """(source_id, pages, entries, finished, notice): a short page ends a listing; one that ends with its budget only is told (A1).

    ``pages``: source_id, page, entries.
    """
    g = pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.sum("entries").alias("entries"), F.max(F.col("entries") < page_size).alias("finished"))
    return g.withColumn("notice", F.when(~F.col("finished") & (F.col("pages") >= budget), F.format_string("page budget of %d used up", F.lit(budget))))


def harvest_cursor(payloads: DataFrame, sets: int) -> DataFrame:
    """(source_id, set_index, resumption_token, done): where a harvest goes on after its last answer (A3).

    ``payloads``: source_id, set_index, fetched_at, body. A token goes on in its set; none goes on to the next, and after
    the last set the harvest is done.
    """
    last = payloads.groupBy("source_id").agg(F.max_by(F.struct("set_index", "body"), F.struct("set_index", "fetched_at")).alias("x")).select("source_id", "x.set_index", "x.body")
    # the token is an element of the answer; its own text may be empty
    answer = F.from_xml("body", "struct<ListRecords: struct<resumptionToken: string>>", {"ignoreNamespace": "true"})["ListRecords"]["resumptionToken"]
    token = F.nullif(F.trim(answer), F.lit(""))
    after = F.when(token.isNotNull(), F.col("set_index")).otherwise(F.col("set_index") + 1)
    return last.select("source_id", F.least(after, F.lit(sets)).cast("int").alias("set_index"), token.alias("resumption_token"), (token.isNull() & (after >= sets)).alias("done"))


def rewound(cursors: DataFrame, since: Column) -> DataFrame:
    """Cursors for a replay: validators and positions are cleared and the watermark set, other columns stay."""
    cleared = {"etag", "last_modified", "last_seen_id", "resumption_token"}
    return cursors.select(*[since.cast(t).alias(n) if n == "watermark" else F.lit(None).cast(t).alias(n) if n in cleared else F.col(n) for n, t in cursors.dtypes])
