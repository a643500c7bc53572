"""Search over lines: literal, regex and boolean hits with positions, totals, paging, scopes, context and views.

Lines are ``file, line, text`` (``byte`` optional: the line's start in the file). A hit is
``file, line, byte, col_start, col_end``; columns are UTF-8 byte offsets within the line. Regexes see one line at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boolean
from ..functions.instants import bind
from ..functions.text import byte_length, java_regex, present, quoted
from ..runtime import cut

HIT = ["file", "line", "byte", "col_start", "col_end"]


# ---- predicates ----


def literal_condition(text: Column, needle: str, sensitive: bool = False) -> Column:
    """Lines that contain the literal; insensitive matching is simple Unicode case folding. An empty needle matches nothing."""
    if not needle:
        return F.lit(False)
    t = present(text)
    return t.contains(needle) if sensitive else t.rlike("(?iu)" + quoted(needle))


def required_clauses(pattern: str) -> list[list[str]]:
    """What every match of a pattern contains: for each clause at least one of its literals (the longest runs of plain
    characters, through groups and alternations; look-around demands nothing). Sound, not complete; empty if unsure."""
    try:
        tree = re._parser.parse(pattern.replace("(?<", "(?P<") if re.search(r"\(\?<[A-Za-z_]", pattern) else pattern)
    except (re.error, AttributeError, OverflowError, RecursionError):
        return []
    if tree.state.flags & re.IGNORECASE or re.search(r"\(\?[a-zA-Z]*[ix]", pattern):
        return []
    return sorted(_clauses(tree), key=lambda c: (-min(map(len, c)), len(c)))[:4]


def _clauses(items) -> list[list[str]]:
    out, run = [], ""

    def flush() -> None:
        nonlocal run
        if len(run) >= 2:
            out.append([run])
        run = ""

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
        elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
            flush()
            out.extend(_clauses(arg[3]))
        elif name == "ATOMIC_GROUP":
            flush()
            out.extend(_clauses(arg))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            flush()
            if arg[0] >= 1:
                out.extend(_clauses(arg[2]))
        elif name == "BRANCH":
            flush()
            sides = [_clauses(side) for side in arg[1]]
            if all(sides):
                best = [max(side, key=lambda c: min(map(len, c))) for side in sides]
                out.append([w for c in best for w in c])
        elif name in ("ASSERT", "ASSERT_NOT", "AT"):
            if name != "AT":
                flush()
        else:
            flush()
    flush()
    return out


def literal_alternatives(pattern: str) -> list[str] | None:
    """The literals of a pattern that is nothing but an alternation of them, else None."""
    parts, word, escaped = [], "", False
    for c in pattern:
        if escaped:
            if c.isalnum():
                return None
            word, escaped = word + c, False
        elif c == "\\":
            escaped = True
        elif c == "|":
            parts.append(word)
            word = ""
        elif c in ".^$*+?{}[]()":
            return None
        else:
            word += c
    parts.append(word)
    return parts if not escaped and len(parts) > 1 and all(parts) else None


def regex_condition(text: Column, pattern: str, sensitive: bool = True) -> Column:
    """Lines the pattern matches; literals it requires are tested first (written order is kept, and they reach the scan). An
    alternation of literals needs no regex. ValueError if the pattern does not compile."""
    import regex

    try:
        regex.compile(pattern)
    except regex.error as e:
        raise ValueError(f"the pattern does not compile: {e}") from None
    t = present(text)
    words = literal_alternatives(pattern) if sensitive else None
    if words:
        out = t.contains(words[0])
        for w in words[1:]:
            out = out | t.contains(w)
        return out
    out = t.rlike(("" if sensitive else "(?iu)") + java_regex(pattern))
    for clause in reversed(required_clauses(pattern) if sensitive else []):
        has = t.contains(clause[0])
        for w in clause[1:]:
            has = has | t.contains(w)
        out = has & out
    return out


def mode(query: str, regex: bool = False) -> str:
    """``regex``, ``boolean`` or ``literal``, as the search box decides."""
    return "regex" if regex else "boolean" if boolean.is_boolean(query) else "literal"


def condition(text: Column, query: str, regex: bool = False, sensitive: bool = False) -> Column:
    m = mode(query, regex)
    if m == "regex":
        return regex_condition(text, query, sensitive)
    return boolean.condition(query, text, sensitive) if m == "boolean" else literal_condition(text, query, sensitive)


# ---- positions ----


def _with_byte(lines: DataFrame) -> DataFrame:
    return lines if "byte" in lines.columns else lines.withColumn("byte", F.lit(0).cast("long"))


def literal_hits(lines: DataFrame, needle: str, sensitive: bool = True) -> DataFrame:
    """Every non-overlapping occurrence of a literal. Split on the needle gives all offsets inside the JVM."""
    src = _with_byte(lines).where(literal_condition(F.col("text"), needle, sensitive))
    if not needle:
        return src.select("file", "line", "byte", F.lit(0).alias("col_start"), F.lit(0).alias("col_end"))
    rx = ("" if sensitive else "(?iu)") + quoted(needle)
    parts = src.select("file", "line", "byte", F.split("text", rx, -1).alias("p"), F.regexp_extract_all("text", F.lit(rx), F.lit(0)).alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda acc, i: F.struct(
        (acc["at"] + byte_length(F.get("p", i)) + byte_length(F.get("m", i))).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + byte_length(F.get("p", i))).alias("s"), (acc["at"] + byte_length(F.get("p", i)) + byte_length(F.get("m", i))).alias("e")))).alias("out"),
    )
    spans = F.when(F.size("m") > 0, F.aggregate(F.sequence(F.lit(0), F.size("m") - 1), zero, step)["out"])
    return parts.select("file", "line", "byte", F.explode(spans).alias("x")).select("file", "line", "byte", F.col("x.s").alias("col_start"), F.col("x.e").alias("col_end"))


def spans(text: Column, rx: str) -> Column:
    """``array<struct<start:int,end:int,word:string>>``: the non-empty matches of a JVM pattern with their byte columns. The pieces
    between the matches give all offsets inside the JVM; an empty match at the start has no piece before it."""
    pieces, words = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))

    def placed(p: Column, m: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,word:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + byte_length(F.get(p, i - (F.size(m) + 1 - F.size(p))))
            start = F.coalesce(start, acc["at"])
            word = F.get(m, i)
            end = start + byte_length(word)
            return F.struct(end.alias("at"), F.when(word == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), word.alias("word"))))).alias("out"))

        return F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step)["out"])

    return bind(pieces, lambda p: bind(words, lambda m: placed(p, m)))


def regex_hits(lines: DataFrame, pattern: str, sensitive: bool = True) -> DataFrame:
    """Every non-empty match of a pattern with its byte columns, by the engine that also filters the lines."""
    src = _with_byte(lines).where(regex_condition(F.col("text"), pattern, sensitive))
    found = src.select("file", "line", "byte", F.explode(spans(F.col("text"), ("" if sensitive else "(?iu)") + java_regex(pattern))).alias("x"))
    return found.select("file", "line", "byte", F.col("x.start").alias("col_start"), F.col("x.end").alias("col_end"))


def boolean_hits(lines: DataFrame, query: str, sensitive: bool = False) -> DataFrame:
    """One hit a matching line, at its leftmost positive term, else (0, 0)."""
    tree = boolean.parse(query)
    src = _with_byte(lines).where(boolean.condition(tree, F.col("text"), sensitive))
    pos = boolean.first_position(tree, F.col("text"), sensitive)
    t = F.col("text") if sensitive else F.lower("text")
    sizes = {}
    for w in boolean.positive(tree):
        sizes.setdefault(w if sensitive else w.lower(), len((w if sensitive else w.lower()).encode()))
    size = F.lit(0)
    for w, n in sizes.items():
        size = F.when(F.substr(t, F.col("pos"), F.lit(len(w))) == w, F.lit(n)).otherwise(size)
    found = src.withColumn("pos", pos)
    start = F.when(F.col("pos").isNull(), 0).otherwise(byte_length(F.left("text", F.col("pos") - 1)))
    return found.select("file", "line", "byte", start.cast("int").alias("col_start"), (start + F.when(F.col("pos").isNull(), 0).otherwise(size)).cast("int").alias("col_end"))


def hits(lines: DataFrame, query: str, regex: bool = False, sensitive: bool = False) -> DataFrame:
    m = mode(query, regex)
    return regex_hits(lines, query, sensitive) if m == "regex" else boolean_hits(lines, query, sensitive) if m == "boolean" else literal_hits(lines, query, sensitive)


# ---- totals and pages ----


def match_count(text: Column, needle: str, sensitive: bool = True) -> Column:
    """Occurrences of a literal in a line."""
    return F.regexp_count(present(text), F.lit(("" if sensitive else "(?iu)") + quoted(needle)))


def grep_lines(lines: DataFrame, needle: str) -> DataFrame:
    """Lines with a case-sensitive literal."""
    return lines.where(literal_condition(F.col("text"), needle, True))


def search_all(lines: DataFrame, needle: str, sensitive: bool = True, cap: int | None = None) -> DataFrame:
    """``file, hits, truncated`` of every file, also of those without hits."""
    n = F.sum(match_count(F.col("text"), needle, sensitive)).cast("long")
    shown = F.least(F.col("hits"), F.lit(cap)).cast("long") if cap else F.col("hits")
    return lines.groupBy("file").agg(n.alias("hits")).select("file", shown.alias("hits"), (F.col("hits") > cap if cap else F.lit(False)).alias("truncated"))


def page(found: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The next hits in order, after (file, line, col_start) of the last one seen: keyset paging, no offset is counted."""
    if after is not None:
        f, n, c = after
        found = found.where((F.col("file") > f) | ((F.col("file") == f) & ((F.col("line") > n) | ((F.col("line") == n) & (F.col("col_start") > c)))))
    return found.orderBy("file", "line", "col_start").limit(size)


def capped(found: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` hits and the exact total (one row ``total``)."""
    return page(found, cap), found.agg(F.count("*").alias("total"))


def scoped(lines: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Lines of a range of line numbers."""
    if first is not None:
        lines = lines.where(F.col("line") >= first)
    return lines.where(F.col("line") <= last) if last is not None else lines


# ---- neighbours ----


def context(lines: DataFrame, found: DataFrame, around: int) -> DataFrame:
    """Lines up to ``around`` lines from a hit, each once, with ``is_hit``: an equi-join on exploded line numbers, no range join."""
    at = found.select("file", "line").distinct()
    wide = at.select("file", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line"), F.col("line").alias("hit")).groupBy("file", "line").agg(F.max((F.col("hit") == F.col("line")).cast("int")).alias("is_hit"))
    return lines.join(wide, ["file", "line"]).withColumn("is_hit", F.col("is_hit") == 1)


def quick_find(lines: DataFrame, needle: str, line: int, forward: bool = True) -> DataFrame:
    """The next (or previous) line with a literal, seen from ``line``, around the end of the file; one row per file."""
    found = lines.where(literal_condition(F.col("text"), needle))
    n = F.col("line")
    if forward:
        pick = F.coalesce(F.min(F.when(n > line, n)), F.min(n))
    else:
        pick = F.coalesce(F.max(F.when(n < line, n)), F.max(n))
    return found.groupBy("file").agg(pick.alias("line"))


def first_with(lines: DataFrame, needle: str) -> DataFrame:
    """The first line of each file with a literal."""
    return lines.where(literal_condition(F.col("text"), needle)).groupBy("file").agg(F.min("line").alias("line"))


def view(lines: DataFrame, which: str, found: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """All lines, those with hits, or those with bookmarks."""
    if which == "all":
        return lines
    chosen = found if which == "hits" else marks
    return lines.join(chosen.select("file", "line").distinct(), ["file", "line"], "left_semi")


def ranked(lines: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Lines with ``row``, their 1-based rank among the lines of their file: ranks within blocks of line numbers plus the
    number of lines in earlier blocks, so that no file is sorted in one task."""
    blocked = lines.withColumn("__b", F.floor(F.col("line") / block).cast("long"))
    sizes = blocked.groupBy("file", "__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    here = F.row_number().over(Window.partitionBy("file", "__b").orderBy("line"))
    return blocked.withColumn("row", here.cast("long")).join(before, ["file", "__b"]).withColumn("row", F.col("row") + F.col("__o")).drop("__b", "__o")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """``file, first, last``: overlapping and adjacent ranges made one."""
    w = Window.partitionBy("file").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int")
    return ranges.withColumn("o", opens).withColumn("g", F.sum("o").over(w)).groupBy("file", "g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


# ---- sets of lines and kept results ----


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """``file, line`` of two sets of lines: ``union``, ``intersect``, ``minus`` or ``xor``; every line once, nulls are equal."""
    x, y = a.select("file", "line"), b.select("file", "line")
    if how == "xor":
        return x.subtract(y).unionByName(y.subtract(x))
    try:
        return {"union": lambda: x.unionByName(y).distinct(), "intersect": lambda: x.intersect(y), "minus": lambda: x.subtract(y)}[how]()
    except KeyError:
        raise ValueError(f"no set operation {how!r}") from None


class Results:
    """Results of searches under names. Each is computed once and written to the shared folder, so that it can be read again
    and combined with others after its lines have changed."""

    def __init__(self) -> None:
        self._kept: dict[str, DataFrame] = {}

    def keep(self, name: str, found: DataFrame) -> DataFrame:
        """Write a result under a name (in place of an earlier one of that name) and return what was written."""
        self._kept[name] = cut(found)
        return self._kept[name]

    def get(self, name: str, compute=None) -> DataFrame:
        """The result of a name; without one, ``compute()`` is kept."""
        if name not in self._kept:
            if compute is None:
                raise KeyError(name)
            self.keep(name, compute())
        return self._kept[name]

    def names(self) -> list[str]:
        return sorted(self._kept)

    def forget(self, name: str) -> None:
        self._kept.pop(name, None)


# ---- queries as objects ----

# The saved searches offered at first, name -> (query, is it a regex); all ignore case.
PRESETS = {
    "Java: ERROR": ("ERROR", False),
    "Java: FATAL": ("FATAL", False),
    "Java: Exception & cause": ("Exception|Caused by:", True),
    "Java: OutOfMemory": ("OutOfMemoryError", False),
    "Java: Connection refused": ("Connection refused", False),
    "Java: timeout": ("timeout", False),
    "SQL: Checkpoint": ("CHECKPOINT", False),
    "SQL: Transaction": ("TRANSACTION", False),
    "SQL: Rollback": ("ROLLBACK", False),
    "SQL: Commit": ("COMMIT", False),
    "SQL: INSERT INTO": ("INSERT INTO", False),
}


def extend(query: str, word: str, how: str, regex: bool = False) -> str:
    """A query with a selected word added, excluded or put in its place."""
    w = re.escape(word) if regex else f'"{word}"' if any(c.isspace() for c in word) else word
    if how == "replace" or not query.strip() and how == "add":
        return w
    if how == "add":
        return f"{query}|{w}" if regex else f"{query} OR {w}"
    return f"^(?!.*{w}){query}" if regex else f"{query} -{w}".strip()


def suggest(history: list[str], typed: str) -> list[str]:
    """Earlier queries that contain the typed characters in order, the best first (early and dense matches of short queries)."""
    scored = [(s, i, q) for i, q in enumerate(dict.fromkeys(history)) if (s := fuzzy_score(typed, q)) is not None]
    return [q for _, _, q in sorted(scored)][:30]


def fuzzy_score(typed: str, text: str) -> int | None:
    """Score of a subsequence match (lower is better): twice the first position, plus gaps, plus length / 64; None without one."""
    at, first, last, gaps = 0, None, None, 0
    low = text.lower()
    for c in typed.lower():
        at = low.find(c, at)
        if at < 0:
            return None
        first = at if first is None else first
        gaps += 0 if last is None else at - last - 1
        last, at = at, at + 1
    return (first or 0) * 2 + gaps + len(text) // 64
