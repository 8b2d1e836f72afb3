"""Open JSON documents: first value of several paths, merges, and the ISO form of instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a provider's notice names its message, in order, and where it states an error.
MESSAGE_PATHS = ("$.send.message_id", "$.delivery.message_id", "$.bounce.message_id", "$.complaint.message_id", "$.reject.message_id", "$.message.message_id", "$.message_id")
ERROR_PATHS = ("$.bounce.type", "$.bounce.sub_type", "$.reject.reason", "$.complaint.type", "$.error")


def first_path(json: Column, paths: tuple[str, ...], otherwise: Column | None = None) -> Column:
    """The first value that is not null of several paths, else ``otherwise``."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths], *([otherwise] if otherwise is not None else []))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; on a key of both the right one's value counts, null included; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def iso_utc(at: Column) -> Column:
    """An instant as ISO text in UTC with a Z: microseconds where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("Z"))


def from_iso(text: Column) -> Column:
    """The instant of an ISO text; without a zone it is in UTC; null where it is none."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def send_at(day: Column, zone: str = "Asia/Shanghai", hour: int = 13, minute: int = 45) -> Column:
    """The instant at which a local day's message goes out."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {hour:02}:{minute:02}:00")), "yyyy-MM-dd HH:mm:ss"), zone)
