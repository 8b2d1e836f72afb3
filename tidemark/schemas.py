"""Schemas of the engine's tables, and the check that a table still has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _s(ddl: str) -> T.StructType:
    from pyspark.sql.types import StructField, StructType

    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()), "map": T.MapType(T.StringType(), T.StringType())}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


TABLES = {
    "records": _s("source_id string, external_id string, canonical_url string, title string, summary string, content string, authors strings, published_at timestamp, updated_at timestamp, metadata map"),
    "items": _s("id string, source_id string, native_id string, canonical_url string, title string, first_seen_at timestamp, last_seen_at timestamp, content_hash string"),
    "versions": _s("id string, item_id string, version_key string, content_hash string, title string, normalized_text string, embedding floats, fetched_at timestamp"),
    "history": _s("entity string, version int, hash string, valid_from bigint, valid_to bigint"),
    "cursors": _s("source_id string, etag string, last_modified string, last_seen_id string, last_seen_at timestamp"),
    "health": _s("source_id string, status string, failures int, last_success_at timestamp, retry_at timestamp"),
}


def differences(df: DataFrame, schema: T.StructType) -> list[str]:
    """What a table lacks or holds in another type; extra columns are no difference."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()} for {f.dataType.simpleString()}" for f in schema.fields if have.get(f.name) != f.dataType]


def check(df: DataFrame, table: str) -> DataFrame:
    """``df``, or an error that names every difference."""
    bad = differences(df, TABLES[table])
    if bad:
        raise ValueError(f"{table}: " + "; ".join(bad))
    return df
