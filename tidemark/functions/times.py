"""Mixed timestamp texts to one UTC instant, as Column expressions.

An ordered cascade of anchored patterns is parsed strictly; the first pattern that fits decides, and a text that
fits one but names an impossible date gives null. Text without a zone is local time in the source's zone.

Defined results: null, blank and unreadable texts give null; a null or unknown source zone means UTC; a null
``date_order`` means day first. A repeated local hour means its first pass (the offset before the change), a skipped
one is read with the offset before the change; both are what ``to_utc_timestamp`` does, and tests pin it.
Digits finer than a microsecond are dropped; missing time parts are zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by number (English, German, French).
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jänner": 1, "janvier": 1,
    "feb": 2, "february": 2, "februar": 2, "février": 2, "fevrier": 2,
    "mar": 3, "march": 3, "märz": 3, "maerz": 3, "mars": 3,
    "apr": 4, "april": 4, "avril": 4,
    "may": 5, "mai": 5,
    "jun": 6, "june": 6, "juni": 6, "juin": 6,
    "jul": 7, "july": 7, "juli": 7, "juillet": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9,
    "oct": 10, "october": 10, "oktober": 10, "octobre": 10,
    "nov": 11, "november": 11, "novembre": 11,
    "dec": 12, "december": 12, "dezember": 12, "décembre": 12, "decembre": 12,
}

# Minutes east of UTC of abbreviations with one meaning here.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "NZST": 720, "NZDT": 780,
}

# Abbreviations several zones share: (pattern of the source's zone, minutes); the last entry is the default.
SHARED = {
    "CST": [("^(Asia/(Shanghai|Chongqing|Harbin|Macau|Taipei)|PRC|ROC)$", 480), ("^America/Havana$", -300), ("", -360)],
    "IST": [("^(Asia/(Jerusalem|Tel_Aviv)|Israel)$", 120), ("^(Europe/Dublin|Eire)$", 60), ("", 330)],
    "BST": [("^Asia/(Dhaka|Dacca)$", 360), ("^Pacific/Bougainville$", 660), ("", 60)],
    "AST": [("^Asia/(Riyadh|Baghdad|Kuwait|Qatar)$", 180), ("", -240)],
    "ADT": [("^Asia/Baghdad$", 240), ("", -180)],
    "SST": [("^Asia/Singapore$", 480), ("", -660)],
}

_DAY = r"(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
_HM = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(z|utc[+-]\d{1,2}(?::?\d{2})?|gmt[+-]\d{1,2}(?::?\d{2})?|[+-]\d{2}:?\d{2}|[+-]\d{2}|[a-z]{2,4})"


@dataclass(frozen=True)
class Shape:
    """A pattern, anchored on both ends and without regard to case, and the group number of each part."""

    pattern: str
    parts: dict[str, int]

    @property
    def anchored(self) -> str:
        return f"(?iu)^{self.pattern}$"


SHAPES = (
    Shape(r"(\d{4})(\d{2})(\d{2})", {"y": 1, "mo": 2, "d": 3}),
    Shape(r"([+-]?\d{1,19})", {"count": 1}),
    Shape(rf"(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[t ]\s*{_HM}\s*{_ZONE}?(?:\[[a-z0-9_+/-]+\])?)?", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8}),
    Shape(rf"(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE}?", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8}),
    Shape(rf"(?:{_DAY},?\s+)?(\d{{1,2}})\s+(\p{{L}}+)\.?\s+(\d{{4}}),?\s+{_HM}(?:\s*{_ZONE})?(?:\s*\([a-z]+\))?", {"d": 1, "mon": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8}),
    Shape(rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_HM}(?:\s*{_ZONE})?)?", {"n1": 1, "n2": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8}),
    Shape(rf"(\d{{1,2}})-(\p{{L}}+)-(\d{{4}}|\d{{2}})(?:\s+{_HM}(?:\s*{_ZONE})?)?", {"d": 1, "mon": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "zone": 8}),
    Shape(rf"(\p{{L}}+)\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?(?:\s+at)?\s+{_HM}\s*(am|pm)?(?:\s*{_ZONE})?)?", {"mon": 1, "d": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "half": 8, "zone": 9}),
    Shape(rf"(\d{{1,2}})\.\s*(\p{{L}}+)\s+(\d{{4}})(?:,?\s+(?:um\s+)?{_HM}(?:\s*uhr)?)?", {"d": 1, "mon": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7}),
    Shape(r"(\d{1,2})(?:er)?\s+(\p{L}+)\s+(\d{4})(?:,?\s+à\s+(\d{1,2})\s*h\s*(\d{2})?)?", {"d": 1, "mon": 2, "y": 3, "h": 4, "mi": 5}),
    Shape(rf"(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日(?:\s*{_HM})?", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7}),
)

_ZONES = sorted(z for z in available_timezones() if "/" in z or z == "UTC")


def _lookup(key: Column, table: dict) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def _offset_minutes(zone: Column, source_zone: Column) -> Column:
    """Minutes east of UTC of an explicit zone text; null where it is unknown."""
    up = F.upper(zone)
    signed = F.regexp_extract(up, r"^(?:UTC|GMT)?([+-])(\d{1,2}?):?(\d{2})?$", 1)
    hours = F.regexp_extract(up, r"^(?:UTC|GMT)?[+-](\d{2}|\d):?(\d{2})?$", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(up, r"^(?:UTC|GMT)?[+-](\d{2}|\d):?(\d{2})?$", 2).try_cast("int"), F.lit(0))
    numeric = F.when(up.rlike(r"^(UTC|GMT)?[+-]\d") & (hours <= 18) & (minutes < 60), F.when(signed == "-", F.lit(-1)).otherwise(F.lit(1)) * (hours * 60 + minutes))
    out = F.coalesce(numeric, _lookup(up, ABBREVIATIONS))
    for name, meanings in SHARED.items():
        chosen = F.lit(meanings[-1][1])
        for pattern, value in reversed(meanings[:-1]):
            chosen = F.when(source_zone.rlike(pattern), F.lit(value)).otherwise(chosen)
        out = F.when(up == name, chosen).otherwise(out)
    return out


NAMES = ("y", "mo", "d", "n1", "n2", "mon", "h", "mi", "s", "f", "half", "zone", "count")


def _cascade(text: Column) -> Column:
    """The parts of the first pattern that fits, in the order of ``NAMES``, parted by bars; null where none does.

    A pattern is anchored, so that one replacement turns a whole text into its parts.
    """
    clean = F.regexp_replace(text, r"(?U)^[\s\u200B\uFEFF]+|[\s\u200B\uFEFF]+$", "")

    def parts(shape: Shape) -> Column:
        return F.regexp_replace(clean, shape.anchored, "|".join(f"${shape.parts[n]}" if n in shape.parts else "" for n in NAMES))

    return reduce(lambda rest, shape: F.when(clean.rlike(shape.anchored), parts(shape)).otherwise(rest), reversed(SHAPES), F.lit(None).cast("string"))


class _Parts:
    """Parts by name; a part that is missing is null."""

    def __init__(self, values: Column) -> None:
        self.values = values

    def __getitem__(self, name: str) -> Column:
        return F.nullif(F.get(self.values, F.lit(NAMES.index(name))), F.lit(""))


def _once(parts: Column, use) -> Column:
    """``use`` of parts that are named once: a transform over one element, so that the cascade isn't evaluated for every part."""
    return F.element_at(F.transform(F.array(F.split(parts, r"\|")), lambda p: use(_Parts(p))), 1)


def utc_micros(text: Column, source_zone: Column, date_order: Column) -> Column:
    """Microseconds since 1970 UTC that ``text`` states, as BIGINT; null where it states no possible instant."""
    zone = F.when(source_zone.isin(_ZONES), source_zone).otherwise(F.lit("UTC"))
    return _once(_cascade(text), lambda p: _count(p, zone, date_order))


def states_second_and_zone(text: Column) -> Column:
    """Whether ``text`` names its second and its zone, or counts from 1970 UTC."""
    return F.coalesce(_once(_cascade(text), lambda p: p["count"].isNotNull() | (p["s"].isNotNull() & p["zone"].isNotNull())), F.lit(False))


def _count(p: _Parts, zone: Column, date_order: Column) -> Column:
    num = lambda c: c.try_cast("int")
    month_first = F.coalesce(date_order, F.lit("dmy")) == "mdy"
    year = F.when(F.length(p["y"]) == 2, num(p["y"]) + 2000).otherwise(num(p["y"]))
    month = F.coalesce(num(p["mo"]), _lookup(F.lower(p["mon"]), MONTHS), num(F.when(month_first, p["n1"]).otherwise(p["n2"])))
    day = F.coalesce(num(p["d"]), num(F.when(month_first, p["n2"]).otherwise(p["n1"])))
    h = F.coalesce(num(p["h"]), F.lit(0))
    half = F.lower(p["half"])
    hour = F.when(half.isNull(), h).when((h >= 1) & (h <= 12), h % 12 + F.when(half == "pm", 12).otherwise(0))
    minute, second = F.coalesce(num(p["mi"]), F.lit(0)), F.coalesce(num(p["s"]), F.lit(0))
    micro = F.coalesce(F.rpad(F.substring(p["f"], 1, 6), 6, "0").try_cast("int"), F.lit(0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)).otherwise(31)
    possible = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= last) & hour.between(0, 23) & (minute < 60) & (second < 60)
    # days since 1970 of a proleptic Gregorian date, by whole numbers: March-based years of 400-year eras
    y = F.when(month <= 2, year - 1).otherwise(year).cast("bigint")
    in_year = F.floor((153 * ((month + 9) % 12) + 2) / 5) + day - 1
    days = F.lit(365) * y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + in_year - 719468
    local = (((days * 24 + hour) * 60 + minute) * 60 + second) * 1_000_000 + micro
    offset = _offset_minutes(p["zone"], zone)
    stated = F.when(p["zone"].isNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))).otherwise(local - offset.cast("bigint") * 60_000_000)
    n = p["count"].try_cast("bigint")
    digits = F.length(F.regexp_replace(p["count"], "^[+-]", ""))
    counted = F.when(digits <= 11, n * 1_000_000).when(digits <= 14, n * 1000).when(digits <= 17, n).otherwise(F.floor(n / 1000))
    return F.when(p.values.isNull(), F.lit(None)).when(p["count"].isNotNull(), counted).when(possible, stated).cast("bigint")


def retry_at(text: Column, now: Column) -> Column:
    """When a retry header allows another try: seconds from ``now`` or a date; null for anything else."""
    seconds = F.when(text.rlike(r"^\s*\d{1,9}\s*$"), F.trim(text).cast("bigint"))
    return F.coalesce(F.timestamp_micros(F.unix_micros(now) + seconds * 1_000_000), F.when(seconds.isNull(), F.timestamp_micros(utc_micros(text, F.lit("UTC"), F.lit("dmy")))))
