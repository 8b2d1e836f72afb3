"""File scans: payload folders, label lines, configuration rows, object listings; and the choice of a parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import apis, feeds, pages
from tidemark.sources.contract import RECORD

#: Parsers by source kind (A28). Each takes payloads and its options.
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "rss": feeds.rss, "arxiv_api": feeds.preprint_atom, "arxiv_oai": feeds.harvest, "pmlr": feeds.proceedings, "sitemap": feeds.sitemap, "openreview_api": apis.conference_notes, "acl_anthology": pages.anthology_events,
    "github_releases": apis.releases, "huggingface_models": apis.models, "sec_submissions": apis.filings, "sse_announcements": apis.exchange_announcements, "cninfo_announcements": apis.disclosure_announcements,
    "samr_standards": apis.standards, "html": pages.listing, "article": pages.articles,
}
#: Options that a kind's parser can't do without.
NEEDED = {"sec_submissions": ("today",), "sse_announcements": ("codes",), "sitemap": ("patterns",)}


def payload_files(spark: SparkSession, folder: str, source_id: str) -> DataFrame:
    """One payload a file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select(F.lit(source_id).alias("source_id"), F.col("path").alias("url"), F.col("content").cast("string").alias("body"), F.col("modificationTime").alias("fetched_at"))


def parse(payloads: DataFrame, kinds: dict[str, str], options: dict[str, dict] | None = None) -> tuple[DataFrame, list[str]]:
    """(records, sources left out): each source's payloads through the parser of its kind, with the kind's ``options``.

    A source of an unknown kind, or of one whose needed options aren't given, is left out and named.
    """
    given = options or {}
    known = {s: k for s, k in kinds.items() if k in PARSERS and all(o in given.get(k, {}) for o in NEEDED.get(k, ()))}
    out = payloads.sparkSession.createDataFrame([], RECORD)
    for kind in sorted(set(known.values())):
        out = out.unionByName(PARSERS[kind](payloads.where(F.col("source_id").isin([s for s, k in known.items() if k == kind])), **given.get(kind, {})))
    return out, sorted(set(kinds) - set(known))


def label_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Labels of a JSONL file; blank and # lines are skipped, a line that breaks the schema or a repeated key fails."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    twice = rows.groupBy(key).count().where(f"count > 1 or {key} is null")
    first = twice.first()
    if first is not None:
        raise ValueError(f"label {first[0]!r} is repeated or has no key")
    return rows


def config_rows(spark: SparkSession, rows: list[dict], defaults: dict, columns: list[str]) -> DataFrame:
    """Configuration rows over their defaults; keys beyond ``columns`` go to a config map."""
    merged = [{**defaults, **r} for r in rows]
    flat = [(*[None if m.get(c) is None else str(m[c]) for c in columns], {k: str(v) for k, v in m.items() if k not in columns}) for m in merged]
    return spark.createDataFrame(flat, ", ".join(f"{c} string" for c in columns) + ", config map<string,string>")


def object_listing(spark: SparkSession, folder: str, most: int | None = None, depth: int | None = None) -> DataFrame:
    """(path, day, bytes) of stored objects, the day from their dated folders; contents are not read.

    With ``most`` or ``depth`` the listing fails where there are more objects or deeper folders, instead of giving a part.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    day = F.regexp_extract("path", r"/(\d{4}/\d{2}/\d{2})/", 1)
    out = f.select("path", F.to_date(F.nullif(day, F.lit("")), "yyyy/MM/dd").alias("day"), F.col("length").alias("bytes"))
    if most is not None and f.count() > most:
        raise ValueError(f"more than {most} objects")
    if depth is not None:
        below = F.size(F.split(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + folder.rstrip("/"), ""), "/")) - 2
        if f.where(below > depth).take(1):
            raise ValueError(f"folders deeper than {depth}")
    return out


def relation_sizes(spark: SparkSession, folders: dict[str, str], k: int = 20) -> DataFrame:
    """(relation, files, bytes): the largest tables by stored bytes."""
    out = None
    for name, folder in folders.items():
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        one = f.select(F.lit(name).alias("relation"), "length")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("relation").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), "relation").limit(k)
