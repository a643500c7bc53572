"""Mixed time formats against a plain datetime version, and the defined results."""

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidemark.functions.instants import with_instant
from tidemark.operators.normalise_times import normalised

UTC = dt.timezone.utc


def instants(spark, rows):
    df = spark.createDataFrame(rows, "i int, text string, tz_name string, year int")
    return {r["i"]: r["micros"] for r in with_instant(df, "text").collect()}


def test_formats_agree_with_datetime(spark):
    rows, want = [], {}
    for i in range(300):
        zone = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Asia/Kathmandu", "UTC"][i % 5]
        at = dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(hours=29 * i, seconds=37 * i, microseconds=1000 * i)
        if at.year != 2026:
            continue
        local = at.astimezone(ZoneInfo(zone))
        if local.fold or (local.replace(fold=1).utcoffset() != local.utcoffset()):
            continue
        off = local.strftime("%z")
        forms = [
            local.strftime("%Y-%m-%d %H:%M:%S"),
            local.strftime("%Y/%m/%d %H:%M:%S"),
            local.strftime("%Y-%m-%dT%H:%M:%S") + off[:3] + ":" + off[3:],
            at.strftime("%Y%m%dT%H%M%SZ"),
            local.strftime("%d/%b/%Y:%H:%M:%S ") + off,
            local.strftime("%a, %d %b %Y %H:%M:%S ") + off,
            local.strftime("%b %e %H:%M:%S"),
            local.strftime("%d/%m/%Y %H:%M:%S"),
            local.strftime("%m/%d/%Y %I:%M:%S %p"),
            str(int(at.timestamp())),
            str(int(at.timestamp()) * 1000),
            local.strftime("%Y-%m-%dT%H%M%S,000"),
            local.strftime("%d.%m.%Y %H:%M:%S"),
            local.strftime("%H:%M:%S %Y-%m-%d"),
        ]
        rows.append((i, forms[i % len(forms)], zone, 2026))
        want[i] = int(at.timestamp()) * 1_000_000
    got = instants(spark, rows)
    assert got == want


def test_fractions_zones_and_daylight_saving(spark):
    cases = [
        ("2026-03-29T00:33:41.892031+01:00", "UTC", 2026, 1774740821892031),
        ("2026-01-21T09:03:17.572370590-05:00", "UTC", 2026, 1769004197572370),
        ("1789641665.675508", "UTC", 2026, 1789641665675508),
        ("2026-10-15 00:56:02,020 CEST", "Europe/Berlin", 2026, 1792018562020000),
        ("2026-10-25 02:30:00", "Europe/Berlin", 2026, 1792888200000000),  # twice: the first
        ("2026-10-25 02:30:00 CET", "Europe/Berlin", 2026, 1792891800000000),
        ("2026-03-29 02:30:00", "Europe/Berlin", 2026, 1774747800000000),  # skipped: forward by the gap
        ("2026-06-01 10:00:00", "No/Zone", 2026, 1780308000000000),
        ("2026-06-01 10:00:00", None, 2026, 1780308000000000),
        ("Feb 29 10:00:00", "UTC", 2028, 1835431200000000),
        ("[2026-06-01 10:00:00Z]", "Asia/Kolkata", 2026, 1780308000000000),
        ("12:00:00 AM", "UTC", 2026, None),
        ("01/02/2026 12:00:00 AM", "UTC", 2026, 1767312000000000),
    ]
    got = instants(spark, [(i, t, z, y) for i, (t, z, y, _) in enumerate(cases)])
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_invalid_and_missing_times_are_null(spark):
    bad = [None, "", " ", "-", "unknown", "N/A", "??:??:??", "2026-02-30 10:00:00", "2026-13-07 10:01:00", "2026-01-07 10:61:00", "0000-00-00 00:00:00", "Feb 29 10:00:00", "2026-01-01 10:00:00 XYZ", "x" * 10000, "13/25/2026 10:00:00 PM"]
    assert set(instants(spark, [(i, t, "UTC", 2026) for i, t in enumerate(bad)]).values()) == {None}
    assert instants(spark, [(1, "Feb 20 10:00:00", "UTC", None)]) == {1: None}


def test_normalised_tables(spark):
    doc = spark.createDataFrame([("a", "UTC", dt.datetime(2026, 5, 1)), ("a", "UTC", dt.datetime(2026, 5, 1)), (None, "UTC", None)], "file string, tz_name string, mtime timestamp")
    rows = spark.createDataFrame([("a", 1, "2026-01-01 00:00:00.9", 1767225600), ("a", 1, "2026-01-01 00:00:00.9", 1767225600), ("b", 2, "Jan  1 00:00:00", 5), (None, None, None, None)], "file string, line long, t string, ts long")
    rows = rows.withColumn("year", F.lit("clash")).withColumn("tz_name", F.lit("clash"))
    got = {(r["file"], r["line"]): r["seconds"] for r in normalised(rows, doc, "t").collect()}
    assert got == {("a", 1): 1767225600, ("b", 2): None, (None, None): None}
    assert normalised(rows.limit(0), doc.limit(0), "t").count() == 0
