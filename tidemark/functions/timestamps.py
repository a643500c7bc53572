"""The timestamp prefix of log lines, ranges and jumps by time.

A line is dated if it starts with ``YYYY-MM-DD HH:MM:SS`` (``-`` or ``/``, blank or ``T``): month 1-12, day 1-31 in any
month (surplus days roll over), second up to 60. Seconds of Unix time, no zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lookup_join
from .instants import bind, epoch_day

PREFIX = r"^(\d{4})[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])[ T]([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)"


def prefix_seconds(text: Column) -> Column:
    """Seconds of the timestamp at the start of a line, or null. One regex run finds and cuts it."""

    def seconds(p: Column) -> Column:
        y, m, d, h, mi, s = (F.get(p, i).cast("long") for i in range(6))
        return epoch_day(y, m, d) * 86400 + h * 3600 + mi * 60 + s

    parts = F.split(F.regexp_replace(F.left(text, F.lit(19)), PREFIX + "$", "$1,$2,$3,$4,$5,$6"), ",")
    return F.when(text.rlike(PREFIX), bind(parts, seconds))


def seconds_of(text: str) -> int | None:
    """The same for one string, on the driver."""
    m = re.match(PREFIX, text)
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    yy, mm = (y - 1, mo + 9) if mo <= 2 else (y, mo - 3)
    days = yy * 365 + yy // 4 - yy // 100 + yy // 400 + (mm * 153 + 2) // 5 + d - 1 - 719468
    return days * 86400 + h * 3600 + mi * 60 + s


def prefix_length(text: Column) -> Column:
    """19 where the line starts like a timestamp (digits and separators, ranges unchecked), else 0."""
    return F.when(text.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}"), 19).otherwise(0)


def goto(text: str) -> tuple[str, int | float | None]:
    """What a jump's input means: ('line', n) with dots allowed, ('percent', p), ('first'|'last', None), ('time', seconds) or ('text', None)."""
    t = text.strip()
    if re.fullmatch(r"[\d.]+", t) and t.replace(".", "").isdigit():
        return "line", int(t.replace(".", ""))
    if m := re.fullmatch(r"(\d+(?:[.,]\d+)?)\s*%", t):
        return "percent", float(m[1].replace(",", "."))
    if t.lower() in ("end", "akhir"):
        return "last", None
    if t.lower() in ("start", "awal"):
        return "first", None
    if (s := seconds_of(t)) is not None:
        return "time", s
    return "text", None


def percent_line(total: Column, percent: float) -> Column:
    """Line at a percentage of a file, within 1 and the total."""
    return F.greatest(F.lit(1), F.least(total, F.round(total * (percent / 100.0)))).cast("long")


def goto_time(lines: DataFrame, seconds: int) -> DataFrame:
    """``file, line``: each file's first line dated at or after a time. Works for any order of times; all files at once."""
    at = prefix_seconds(F.col("text"))
    return lines.where(at >= seconds).groupBy("file").agg(F.min("line").alias("line"))


def time_range(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Each file's contiguous lines from the first one dated at or after ``start`` to the last before the first one dated after
    ``end``; undated lines between belong to it."""
    if end < start:
        raise ValueError("the range ends before it starts")
    at = prefix_seconds(F.col("text"))
    b = lines.groupBy("file").agg(F.min(F.when(at >= start, F.col("line"))).alias("lo"), F.min(F.when(at > end, F.col("line"))).alias("hi"))
    return lookup_join(lines, b, ["file"], "inner", salt_by=F.col("line")).where((F.col("line") >= F.col("lo")) & F.coalesce(F.col("line") < F.col("hi"), F.lit(True))).drop("lo", "hi")


def toggle_bookmark(marks: DataFrame, lines: DataFrame, file: str, line: int) -> DataFrame:
    """Bookmarks (``file, line, label``) with one added or taken away; a label is the first 60 characters of the line."""
    here = (F.col("file") == file) & (F.col("line") == line)
    had = marks.where(here)
    new = lines.where(here).select("file", "line", F.left("text", F.lit(60)).alias("label")).join(had.select("file", "line"), ["file", "line"], "left_anti")
    return marks.where(~here).unionByName(new)


def neighbour_mark(marks: DataFrame, line: int, forward: bool = True) -> DataFrame:
    """The next or previous bookmark of each file, around its end."""
    n = F.col("line")
    pick = F.coalesce(F.min(F.when(n > line, n)), F.min(n)) if forward else F.coalesce(F.max(F.when(n < line, n)), F.max(n))
    return marks.groupBy("file").agg(pick.alias("line"))
