"""Timestamps in mixed formats, precisions and zones -> one unambiguous instant (problem 2).

All formats are compiled into one regex alternation with named groups. One ``regexp_replace`` runs it
once per value and writes the components, merged over the alternatives, in one canonical order; integer
day arithmetic assembles the instant. Everything stays in the JVM.

Defined results
* null, empty, unreadable text, or an impossible calendar date or time of day -> null;
* offset or ``Z`` in the text: that offset; a zone abbreviation: the one of the file's own zone
  (``UTC``/``GMT``/``Z`` mean offset 0 everywhere), an abbreviation the zone does not use -> null;
* neither: wall time of the file's zone; twice-occurring wall times mean the first occurrence, skipped
  ones count forward by the length of the gap; a null or unknown zone name means UTC;
* no year: the year given by the caller (null -> null result);
* all-numeric slash dates: month first with AM/PM, else day first; dotted dates: day first;
* 9-11 digits are seconds, 12-14 milliseconds, 15-17 microseconds, 18-19 nanoseconds of Unix time.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_SEP = "\u0001"

# Pieces of the alternation; {n} numbers the alternative, so that group names stay unique.
_HMS = r"(?<h{n}>\d{{1,2}}):(?<mi{n}>\d{{2}}):(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,9}}))?"


def _forms(abbreviation: str, month: str, day: str, epoch: str) -> list[str]:
    """The formats, over patterns for zone abbreviations, the names of months and days and times in Unix seconds."""
    zone = r"(?:\s*(?<z{n}>Z|[+-]\d{{2}}:?\d{{2}}(?!\d)|" + abbreviation + r"))?"
    mon = rf"(?<mn{{n}}>{month})[a-z]{{{{0,6}}}}"
    dayname = rf"(?:{day},?\s+)?"
    return [
        # 2026-03-29T00:33:41.892031+01:00   2026/07/14 10:25:09   2026-03-29T005416,182   2026-02-08 10:23:01,865 AEDT
        r"(?<y{n}>\d{{4}})(?<q{n}>[-/.])(?<mo{n}>\d{{1,2}})\k<q{n}>(?<d{n}>\d{{1,2}})(?:[T_ ]\s*)(?<h{n}>\d{{2}})(?<c{n}>:?)(?<mi{n}>\d{{2}})\k<c{n}>(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,9}}))?" + zone,
        # 20260329T010926Z
        r"(?<y{n}>\d{{4}})(?<mo{n}>\d{{2}})(?<d{n}>\d{{2}})[T_ ](?<h{n}>\d{{2}})(?<mi{n}>\d{{2}})(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,9}}))?" + zone,
        # 29/Mar/2026:00:34:15 +0100   26-Aug-2026 05:47:57.199   Thu, 18 Jun 2026 18:08:09 +0530
        dayname + r"(?<d{n}>\d{{1,2}})[-/\s]" + mon + r"[-/\s](?<y{n}>\d{{4}})[:T\s]\s*" + _HMS + zone,
        # Mar  8 04:16:04   Thu Mar  8 04:16:04 2026
        dayname + mon + r"\s+(?<d{n}>\d{{1,2}})\s+" + _HMS + r"(?:\s+(?<y{n}>\d{{4}})(?!\w))?" + zone,
        # 18/06/2026 18:57:06   11/07/2026 08:39:03 PM
        r"(?<a{n}>\d{{1,2}})/(?<b{n}>\d{{1,2}})/(?<y{n}>\d{{4}})[T\s]\s*" + _HMS + r"(?:\s*(?<p{n}>[AaPp])\.?[Mm]\.?)?" + zone,
        # 31.03.2026 05:21:47
        r"(?<d{n}>\d{{1,2}})\.(?<mo{n}>\d{{1,2}})\.(?<y{n}>\d{{4}})[T\s]\s*" + _HMS + zone,
        # 01:05:48 2026-10-25
        _HMS + r"\s+(?<y{n}>\d{{4}})-(?<mo{n}>\d{{2}})-(?<d{n}>\d{{2}})" + zone,
        # 0328 18:26:54.756875
        r"(?<mo{n}>\d{{2}})(?<d{n}>\d{{2}})\s+" + _HMS,
        # 1769006605   1789641665.675508   1789628264168
        epoch,
    ]


_FORMS = _forms("[A-Za-z]{{3,5}}", "[A-Za-z]{{3}}", "[A-Za-z]{{3,9}}", r"(?<e{n}>-?\d{{9,19}})(?:\.(?<f{n}>\d{{1,9}}))?")
_PARTS = ["y", "mo", "mn", "d", "a", "b", "h", "mi", "s", "f", "z", "p", "e"]


@lru_cache(maxsize=1)
def alternation() -> tuple[str, str]:
    """The compiled alternation and the replacement which writes its components in the order of _PARTS."""
    forms = [f.format(n=i) for i, f in enumerate(_FORMS)]
    present = {p: [i for i, f in enumerate(forms) if f"(?<{p}{i}>" in f] for p in _PARTS}
    out = _SEP.join("".join(f"${{{p}{i}}}" for i in present[p]) for p in _PARTS)
    return r"^\s*\[?(?:" + "|".join(forms) + r")\]?\s*$", _SEP + out


def _int(c: Column) -> Column:
    """A digits-only component as a long; empty -> null."""
    return F.when(c != "", c).cast("long")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def epoch_day(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    mm = F.when(m > 2, m - 3).otherwise(m + 9)
    return yy * 365 + _div(yy, 4) - _div(yy, 100) + _div(yy, 400) + _div(mm * 153 + 2, 5) + d - 1 - 719468


def month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


@lru_cache(maxsize=1)
def _zone_rows() -> list[tuple[str, dict[str, int]]]:
    """Every zone of the tz database with the offset each of its abbreviations stands for (the latest use wins)."""
    out = []
    stamps = [dt.datetime(y, m, 1, tzinfo=dt.timezone.utc) for y in range(1990, 2038) for m in range(1, 13)]
    for name in sorted(available_timezones()):
        zone, abbr = ZoneInfo(name), {}
        for t in stamps:
            local = t.astimezone(zone)
            abbr[local.tzname()] = int(local.utcoffset().total_seconds())
        out.append((name, {k: v for k, v in abbr.items() if k and k[0].isalpha()}))
    return out


@lru_cache(maxsize=1)
def zone_abbreviations() -> list[str]:
    """Every abbreviation of letters that a zone of the tz database uses."""
    return sorted({a for _, abbr in _zone_rows() for a in abbr if a.isalpha()})


def time_pattern(n: str) -> str:
    """The formats as they stand within a line, as one pattern without groups but those of its back references, numbered ``n``."""
    named = [m.capitalize() for m in MONTHS]
    days = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    forms = _forms(rf"(?:{'|'.join(zone_abbreviations())})\b", "|".join(named), f"(?:{'|'.join(days)})[a-z]{{{{0,6}}}}", r"(?<![\w.])(?:\d{{10}}|\d{{13}}|\d{{16}}|\d{{19}})(?:\.\d{{1,9}})?(?![\w.])")
    return "(?:" + "|".join(re.sub(r"\(\?<(?![qc]\{n\}|[!=])\w+\{n\}>", "(?:", f).format(n=n) for f in forms) + r")(?: [AP]M\b)?"


def zone_table(spark: SparkSession) -> DataFrame:
    """``tz_name, tz_abbr map<string,int>``: as many rows as the tz database has zones (about 600, fixed)."""
    return spark.createDataFrame(_zone_rows(), "tz_name string, tz_abbr map<string,int>")


def components(text: Column) -> Column:
    """The alternation run once: array of the components of _PARTS, or null where no format matches."""
    pattern, out = alternation()
    done = F.regexp_replace(text, pattern, out)
    return F.when(done.startswith(_SEP), F.split(F.substring(done, 2, 2**31 - 1), _SEP))


def bind(value: Column, body) -> Column:
    """``let v = value in body(v)``: the value is computed once however often ``body`` uses it, also after predicate pushdown."""
    return F.transform(F.array(value), body)[0]


def _fields(parts: Column, year: Column) -> Column:
    g = {p: F.element_at(parts, i + 1) for i, p in enumerate(_PARTS)}
    pm = F.lower(g["p"])
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(g["mn"]))
    h24 = _int(g["h"])
    return F.struct(
        F.coalesce(_int(g["y"]), year.cast("long")).alias("y"),
        F.coalesce(_int(g["mo"]), F.when(g["mn"] != "", named), F.when(pm != "", _int(g["a"])).otherwise(_int(g["b"]))).alias("m"),
        F.coalesce(_int(g["d"]), F.when(pm != "", _int(g["b"])).otherwise(_int(g["a"]))).alias("d"),
        F.when(pm == "", h24).when(h24.between(1, 12), h24 % 12 + F.when(pm == "p", 12).otherwise(0)).alias("h"),
        _int(g["mi"]).alias("mi"),
        _int(g["s"]).alias("s"),
        _int(g["e"]).alias("e"),
        F.when(g["f"] != "", F.rpad(g["f"], 6, "0").substr(1, 6).cast("long")).otherwise(F.lit(0)).alias("f"),
        F.upper(F.regexp_replace(g["z"], ":", "")).alias("z"),
    )


def _assemble(v: Column, zone: Column, abbr: Column) -> Column:
    y, m, d, h, mi, s, e, frac, z = (v[c] for c in ("y", "m", "d", "h", "mi", "s", "e", "f", "z"))
    size = F.abs(e)
    from_epoch = F.when(size < 10**11, e * 1_000_000 + F.when(e < 0, -frac).otherwise(frac)).when(size < 10**14, e * 1000).when(size < 10**17, e).otherwise(_div(e, 1000))
    valid = m.between(1, 12) & (y >= 1) & (d >= 1) & (d <= month_days(y, m)) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    hours, minutes = z.substr(2, 2).cast("long"), z.substr(4, 2).cast("long")
    numeric = F.when((hours <= 18) & (minutes <= 59), (hours * 3600 + minutes * 60) * F.when(z.startswith("-"), -1).otherwise(1))
    offset = F.when(z.rlike("^[+-]"), numeric).when(z.isin("Z", "UTC", "GMT"), F.lit(0)).otherwise(F.element_at(abbr, z))
    local = (epoch_day(y, m, d) * 86400 + h * 3600 + mi * 60 + s) * 1_000_000 + frac
    wall = bind(local, lambda x: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(x), zone)))
    return F.when(e.isNotNull(), from_epoch).when(valid, F.when(z == "", wall).otherwise(local - offset * 1_000_000))


def instant_micros(text: Column, zone: Column, abbr: Column, year: Column) -> Column:
    """Unix time in microseconds; see the module's docstring for the defined results. ``zone`` must hold valid zone names."""
    return bind(components(text), lambda p: F.when(p.isNotNull(), bind(_fields(p, year), lambda v: _assemble(v, zone, abbr))))


def with_instant(df: DataFrame, text: str, out: str = "micros", tz: str = "tz_name", year: str | None = "year") -> DataFrame:
    """Add ``out``, the instant of column ``text`` in microseconds of Unix time (long, null if there is none).

    ``tz`` names a column of IANA zone names and ``year`` one of years for times that state none; both may hold nulls.
    """
    zones = zone_table(df.sparkSession).withColumnsRenamed({"tz_name": "__tz", "tz_abbr": "__abbr"})
    step = df.join(F.broadcast(zones), F.col(tz) == F.col("__tz"), "left")  # a table of fixed size: the tz database
    when_no_year = F.col(year) if year else F.lit(None)
    micros = instant_micros(F.col(text), F.coalesce("__tz", F.lit("UTC")), F.col("__abbr"), when_no_year)
    return step.withColumn(out, micros).drop("__tz", "__abbr")
