"""Results as text: hits with context, tickets, ranges, searches, CSV. Each is a column ``value``, to be written with ``text``."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_text, fnv1a, line_hash
from ..functions.text import present
from ..sources.files import opened
from . import search


def numbered(lines: DataFrame) -> DataFrame:
    """``number: text`` of lines in order."""
    return lines.orderBy("file", "line").select(F.concat(F.col("line").cast("string"), F.lit(": "), present(F.col("text"))).alias("value"))


def hits_with_context(lines: DataFrame, found: DataFrame, around: int = 2) -> DataFrame:
    """Lines around hits, numbered, each line once."""
    return numbered(search.context(lines, found, around))


def plain_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    return search.scoped(lines, first, last).orderBy("file", "line").select(present(F.col("text")).alias("value"))


def matching(lines: DataFrame, query: str, regex: bool = False, sensitive: bool = False) -> DataFrame:
    """All lines that match a query, numbered, without a cap."""
    return numbered(lines.where(search.condition(F.col("text"), query, regex, sensitive)))


def ticket(lines: DataFrame, found: DataFrame, query: str, around: int = 2) -> DataFrame:
    """A Markdown ticket per file: ``file, value``. Head (file, query, number of hits, context), then each hit line with its
    hash and a fenced block of its context; lines already shown belong to the earlier hit, hit lines are always marked."""
    at = found.select("file", "line").distinct()
    ctx = search.context(lines, at, around).select("file", "line", "text", "is_hit")
    owner = at.select("file", F.col("line").alias("hit"), F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line")).groupBy("file", "line").agg(F.min("hit").alias("first_hit"))
    body = ctx.join(owner, ["file", "line"]).withColumn("hit", F.when(F.col("is_hit"), F.col("line")).otherwise(F.col("first_hit")))
    shown = F.concat(F.when(F.col("is_hit"), ">>> ").otherwise("    "), present(F.col("text")))
    blocks = body.groupBy("file", "hit").agg(F.array_sort(F.collect_list(F.struct("line", shown.alias("s")))).alias("ls"), F.max(F.when(F.col("line") == F.col("hit"), F.col("text"))).alias("anchor"))  # at most 2*around+1 lines
    text = F.concat(F.lit("## Line "), count_text(F.col("hit")), F.lit(" {#"), line_hash(present(F.col("anchor"))), F.lit("}\n```\n"), F.array_join(F.transform("ls", lambda x: x["s"]), "\n"), F.lit("\n```\n"))
    head_of = at.groupBy("file").agg(F.count("*").alias("n"))
    quoted_query = query.replace("`", "'")
    head = head_of.select("file", F.lit(0).cast("long").alias("hit"), F.concat(F.lit("# Log report\n\n- File: `"), "file", F.lit(f"`\n- Query: `{quoted_query}`\n- Hits: "), count_text(F.col("n")), F.lit(f"\n- Context: +-{around} lines\n")).alias("value"))
    return head.unionByName(blocks.select("file", "hit", text.alias("value"))).orderBy("file", "hit").select("file", "value")


def csv_cell(c: Column) -> Column:
    """A cell quoted only where it holds a comma, quote or line break; quotes are doubled."""
    t = present(c.cast("string"))
    return F.when(t.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_rows(df: DataFrame) -> DataFrame:
    """Rows as CSV text, the header apart: ``csv_header(df)``."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in df.columns)


def copied(lines: DataFrame, most: int = 16 * 1024 * 1024, with_numbers: bool = False) -> str:
    """The text of a selection, for the clipboard, each line with its number if asked for; ValueError above ``most`` bytes, checked before anything is fetched."""
    size = lines.agg(F.coalesce(F.sum(F.octet_length(present(F.col("text"))) + 1), F.lit(0)).alias("n")).first()["n"]
    if size > most:
        raise ValueError(f"{size} bytes are too many to copy")
    return "\n".join((f"{r['line']}: " if with_numbers else "") + (r["text"] or "") for r in lines.orderBy("file", "line").select("line", "text").collect())


def save_bookmarks(path: str, source: str, marks: list[dict]) -> None:
    """Bookmarks (line, label, colour) of a file as JSON beside its head's fingerprint."""
    with opened(source) as f:
        head = f"{fnv1a(f.read(65536)):016x}"
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"head": head, "marks": sorted(marks, key=lambda m: m["line"])}, f, ensure_ascii=False)


def load_bookmarks(path: str, source: str) -> tuple[list[dict], bool]:
    """Bookmarks and whether the file is still the same (they are kept if not)."""
    if not os.path.exists(path):
        return [], True
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    with opened(source) as f:
        head = f"{fnv1a(f.read(65536)):016x}"
    return data["marks"], data["head"] == head
