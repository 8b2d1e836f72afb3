"""The record every source parser emits, and the payload every parser reads.

A payload is one fetched response: (source_id, url, body, fetched_at). Fetching is not part of the engine; responses
land as files and are read with ``spark.read``. A parser is a projection of payloads to records; rows that break its
contract are left out, ``rejects`` tells how many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import canonical_url, is_web_url
from tidemark.functions.times import utc_micros

PAYLOAD = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("body", T.StringType()), T.StructField("fetched_at", T.TimestampType())])
FIELDS = ("source_id", "external_id", "canonical_url", "title", "summary", "content", "authors", "published_at", "updated_at", "metadata")
RECORD = "source_id string, external_id string, canonical_url string, title string, summary string, content string, authors array<string>, published_at timestamp, updated_at timestamp, metadata map<string,string>"


def instant(text: Column, zone: Column | str = "UTC", order: str = "dmy") -> Column:
    """A time text as a timestamp; text without a zone is local in ``zone``, an unreadable one gives null."""
    return F.timestamp_micros(utc_micros(text.cast("string"), F.lit(zone) if isinstance(zone, str) else zone, F.lit(order)))


def millis(number: Column) -> Column:
    """Milliseconds since 1970 UTC as a timestamp; null where it isn't a number."""
    return F.timestamp_millis(number.cast("string").try_cast("double").cast("bigint"))


def metadata(**parts: Column) -> Column:
    """A map of the parts that are not null, as text."""
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in parts.items()]))
    return F.map_from_entries(entries)


def records(df: DataFrame, **columns: Column) -> DataFrame:
    """Records of ``df``: missing columns get their empty form; rows without an id or a web address are left out."""
    empty = {
        "summary": F.lit(""), "content": F.lit(""), "authors": F.array().cast("array<string>"), "published_at": F.lit(None).cast("timestamp"),
        "updated_at": F.lit(None).cast("timestamp"), "metadata": F.create_map().cast("map<string,string>"), "source_id": F.col("source_id"),
    }
    c = empty | columns
    c["canonical_url"] = canonical_url(c["canonical_url"])
    out = df.select(*[F.coalesce(c[n], empty[n]).alias(n) if n in ("summary", "content", "authors") else c[n].alias(n) for n in FIELDS])
    ok = F.col("external_id").isNotNull() & (F.col("external_id") != "") & is_web_url(F.col("canonical_url"))
    return out.where(ok)


def first_of(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each (source_id, key) by ``order``, all columns kept: one record an id, as the listing gives them."""
    rest = [c for c in df.columns if c != "source_id"]
    got = df.groupBy("source_id", key.alias("__k")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return got.select("source_id", *[F.col("__x")[c].alias(c) for c in rest])


def rejects(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """(source_id, entries, records, rejected): what each source's parser left out."""
    a = entries.groupBy("source_id").agg(F.count("*").alias("entries"))
    b = parsed.groupBy("source_id").agg(F.count("*").alias("records"))
    n = F.coalesce("records", F.lit(0))
    return a.join(b, "source_id", "left").select("source_id", "entries", n.alias("records"), (F.col("entries") - n).alias("rejected"))
