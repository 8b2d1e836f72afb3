"""Timestamp cascade against zoneinfo, by shape, and on edge cases."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidemark.functions.times import states_second_and_zone, utc_micros
from tidemark.operators.instants import instants

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(dt):
    return (dt - EPOCH) // timedelta(microseconds=1)


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, z string, o string")
    got = {r.i: r.u for r in df.select("i", utc_micros(F.col("t"), F.col("z"), F.col("o")).alias("u")).collect()}
    return [got[i] for i in range(len(rows))]


def test_shapes(spark):
    want = us(datetime(2024, 7, 5, 9, 8, 7, tzinfo=timezone.utc))
    minute = us(datetime(2024, 7, 5, 9, 8, tzinfo=timezone.utc))
    cases = [
        ("2024-07-05T09:08:07Z", want), ("2024-07-05t09:08:07.0z", want), ("20240705T090807Z", want), (str(want // 10**6), want), (str(want // 1000), want), (str(want), want), (str(want * 1000), want),
        ("Fri, 05 Jul 2024 09:08:07 GMT", want), ("Fri, 5 Jul 2024 11:08:07 CEST", want), ("2024-07-05 14:38:07 UTC+5:30", want), ("2024-07-05 05:08:07 UTC-4", want), ("2024-07-05T14:53:07+0545", want),
        ("2024-07-05T05:38:07-03:30", want), ("2024-07-05T11:08:07+02:00[Europe/Berlin]", want), (" \t2024-07-05 09:08\n", minute), ("5. Juli 2024, 09:08 Uhr", minute), ("5 juillet 2024 à 09h08", minute),
        ("2024年7月5日 09:08", minute), ("July 5, 2024 9:08 am", minute), ("July 5, 2024 at 9:08 AM UTC", minute), ("05/07/2024 09:08", minute), ("05-Jul-24 09:08:07", want), ("2024-07-05 09:08:07.123456789Z", want + 123456),
        ("20240705", us(datetime(2024, 7, 5, tzinfo=timezone.utc))), ("2024-07-05", us(datetime(2024, 7, 5, tzinfo=timezone.utc))), ("0", 0), ("9999-12-31T23:59:59Z", us(datetime(9999, 12, 31, 23, 59, 59, tzinfo=timezone.utc))),
        ("0001-01-01T00:00:00Z", us(datetime(1, 1, 1, tzinfo=timezone.utc))), ("July 5, 2024 12:00 am", us(datetime(2024, 7, 5, tzinfo=timezone.utc))), ("July 5, 2024 12:30 pm", us(datetime(2024, 7, 5, 12, 30, tzinfo=timezone.utc))),
    ]
    assert run(spark, [(t, "UTC", "dmy") for t, _ in cases]) == [w for _, w in cases]


def test_impossible_and_nonsense(spark):
    bad = ["", " ", "-", "n/a", "TBD", "soon", "yesterday", "2024-02-30", "2025-02-29T00:00:00Z", "2024-13-05 08:00", "0000-00-00 00:00:00", "2024-01-01T24:00:00Z", "2024-01-01T10:60:00Z", "31/04/2024 10:00", "July 5, 2024 13:00 pm", "5 Foo 2024 10:00:00 GMT", "2024-01-01T00:00:00Q", "20241340", "x" * 10_000, None]
    assert run(spark, [(t, "UTC", "dmy") for t in bad]) == [None] * len(bad)


def test_zone_and_order(spark):
    assert run(spark, [("01/02/2024 00:00", None, "mdy"), ("01/02/2024 00:00", None, None), ("2024-01-01", "No/Such", "dmy")]) == [us(datetime(2024, m, d, tzinfo=timezone.utc)) for m, d in ((1, 2), (2, 1), (1, 1))]
    cst = [us(datetime(2024, 1, 1, tzinfo=timezone(timedelta(hours=h)))) for h in (8, -6)]
    assert run(spark, [("Mon, 01 Jan 2024 00:00:00 CST", "Asia/Shanghai", "dmy"), ("Mon, 01 Jan 2024 00:00:00 CST", "America/Chicago", "dmy")]) == cst


def test_local_times_against_zoneinfo(spark):
    rng = random.Random(3)
    rows, want = [], []
    special = [("America/New_York", datetime(2024, 3, 10, 2, 30)), ("America/New_York", datetime(2024, 11, 3, 1, 30)), ("Europe/Berlin", datetime(2024, 3, 31, 2, 15)), ("Europe/Berlin", datetime(2024, 10, 27, 2, 45)), ("Australia/Sydney", datetime(2024, 10, 6, 2, 5)), ("Australia/Sydney", datetime(2024, 4, 7, 2, 5))]
    for _ in range(300):
        special.append((rng.choice(["America/Los_Angeles", "Europe/London", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney", "Europe/Berlin"]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3 * 525_600))))
    for z, dt in special:
        rows.append((dt.strftime("%Y-%m-%d %H:%M"), z, "dmy"))
        want.append(us(dt.replace(tzinfo=ZoneInfo(z), fold=0)))  # fold 0: the first pass; in a gap, the offset before the change
    assert run(spark, rows) == want


def test_precision(spark):
    cases = [("2024-07-05T09:08:07Z", True), ("1720170487", True), ("2024-07-05 09:08:07", False), ("July 5, 2024 at 9:08 AM UTC", False), ("20240705", False), ("Fri, 05 Jul 2024 09:08:07 GMT", True), ("x", False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.p for r in df.select("i", states_second_and_zone(F.col("t")).alias("p")).orderBy("i").collect()] == [w for _, w in cases]


def test_operator_edges(spark):
    sources = spark.createDataFrame([("s", "Asia/Tokyo", "dmy"), ("s", "Asia/Tokyo", "dmy"), (None, "UTC", "dmy")], "id string, time_zone string, date_order string")
    rows = spark.createDataFrame([("a", "s", "2024-01-01", "x", "extra"), ("a", "s", "2024-01-01", "x", "extra"), ("b", "nowhere", "2024-01-01", None, "e"), (None, "s", "2024-01-01", "0", "e"), ("c", None, None, "0", "e")], "k string, source_id string, p string, u string, row_key string")
    got = {(r.row_key, r.field_name): r.utc_micros for r in instants([(rows, "item", "k", ["p", "u"])], sources).collect()}
    day = us(datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert got == {("a", "p"): day - 9 * 3600 * 10**6, ("b", "p"): day, ("c", "u"): 0}
    assert instants([(rows.limit(0), "item", "k", ["p", "u"])], sources).count() == 0
    assert instants([(rows, "item", "k", ["p"])], sources.limit(0)).count() == 2
