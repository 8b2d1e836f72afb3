"""Public export: a guarded projection, month partitions, feed lines, message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names that must not leave.
FORBIDDEN = ("recipient", "recipient_email", "email", "raw_html", "raw_content", "prompt", "system_prompt", "delivery", "deliveries", "delivery_state", "agentmail_draft_id", "message_id", "api_key", "secret")


def forbidden_fields(schema: T.DataType, path: str = "dataset") -> list[str]:
    """Paths of forbidden names anywhere in a schema; checked on the driver, no row is read (C17)."""
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, path + "[]")
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, path + "{}")
    if not isinstance(schema, T.StructType):
        return []
    own = [f"{path}.{f.name}" for f in schema.fields if f.name.casefold() in FORBIDDEN]
    return own + [p for f in schema.fields for p in forbidden_fields(f.dataType, f"{path}.{f.name}")]


def guard(df: DataFrame, urls: list[str]) -> DataFrame:
    """``df``, or an error for a forbidden field; rows with an unsafe address fail the job when they are read."""
    bad = forbidden_fields(df.schema)
    if bad:
        raise ValueError(f"the export holds forbidden fields: {', '.join(bad)}")
    for u in urls:
        unsafe = F.col(u).isNotNull() & ~F.col(u).rlike(r"(?i)^https?://[^/?#\s]+")
        df = df.withColumn(u, F.when(unsafe, F.raise_error(F.concat(F.lit(f"unsafe address in {u}: "), F.col(u))).cast("string")).otherwise(F.col(u)))
    return df


def write_months(df: DataFrame, at: str, path: str) -> None:
    """One partition a month, in UTC (B8); rows of a month spread over as many files as the writer needs."""
    df.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("overwrite").partitionBy("month").json(path)


def write_snapshots(df: DataFrame, path: str) -> None:
    """Raw snapshots by day of their collection (B5): binary rows in compressed Parquet, not one object a page."""
    df.withColumn("day", F.to_date("collected_at")).write.mode("overwrite").partitionBy("day").option("compression", "gzip").parquet(path)


def escape_xml(text: Column) -> Column:
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def feed_line(title: Column, link: Column, guid: Column, at: Column) -> Column:
    """One feed entry (B9); links are escaped and times are in UTC."""
    stamp = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss")
    return F.concat(F.lit("<item><title>"), escape_xml(title), F.lit("</title><link>"), escape_xml(link), F.lit('</link><guid isPermaLink="false">'), guid, F.lit("</guid><pubDate>"), stamp, F.lit(" +0000</pubDate></item>"))
