"""Text helpers: the three case rules, literal quoting, and the no-null view of strings.

The engine has no nulls in comparisons: a missing field is the empty string. Three case rules exist and are never mixed:
full Unicode lower case (boolean queries, token filters), simple case folding in a regex (literal search), ASCII only
(SQL comparisons, JSON fields).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def present(c: Column) -> Column:
    """The column with null as the empty string."""
    return F.coalesce(c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def ascii_fold(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def quoted(literal: str) -> str:
    """A regex that matches the literal."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", literal)


def java_regex(pattern: str) -> str:
    """A pattern in the common syntax for the JVM: named groups get plain names, classes become Unicode-aware."""
    names: dict[str, str] = {}

    def rename(m: re.Match) -> str:
        return f"(?<{names.setdefault(m[1], f'g{len(names)}')}>"

    out = re.sub(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", rename, pattern)
    out = re.sub(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)", lambda m: f"\\k<{names.get(m[1], m[1])}>", out)
    return "(?U)" + out


def group_names(pattern: str) -> list[tuple[str, int]]:
    """Named groups with their group numbers (the JVM refuses underscores in names, so groups are read by number)."""
    out, number, i, in_class = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            m = re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", pattern[i:])
            if m or pattern[i + 1 : i + 2] != "?":
                number += 1
                if m:
                    out.append((m[1], number))
        i += 1
    return out


def clipped(c: Column, n: int) -> Column:
    """At most ``n`` characters, with an ellipsis if some were cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def without_cr(c: Column) -> Column:
    """One trailing carriage return removed."""
    return F.regexp_replace(c, r"\r\z", "")
