"""The small SQL dialect over parsed lines: text -> AST -> DataFrame operations.

    query := WHERE-expression
           | SELECT (* | COUNT(*) | col {, col}) [FROM name] [WHERE expr] [GROUP BY col {, col}]
             [ORDER BY name [ASC|DESC]] [LIMIT n]
    expr  := OR of AND of [NOT] (parentheses | col op value);  op := = != <> ~ !~ > < >= <=

There are no nulls: a missing field is the empty string. ``=`` and ``~`` ignore ASCII case; order comparisons are numeric
if both sides are numbers, else by time if both start with one, else by ASCII-folded text; the literal's side is typed at
plan time. Counts are exact, with no cap on groups; ties of counts are ordered by the group.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, ascii_lower, present
from ..functions.timestamps import prefix_seconds, seconds_of
from ..operators.parse import Parser, lowered, records

RESERVED = {"SELECT", "FROM", "WHERE", "GROUP", "BY", "ORDER", "LIMIT", "AND", "OR", "NOT", "ASC", "DESC", "COUNT"}
DEFAULT_LIMIT, MAX_LIMIT = 1000, 100_000
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^']|'')*'|"[^"]*")|(?P<op>!~|!=|<>|>=|<=|=|<|>|~)|(?P<sym>[(),*])|(?P<word>[^\s'"()<>=!~,*]+))""")
_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf(?:inity)?|nan)\s*", re.IGNORECASE)
_NUMBER_SQL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?|nan))\s*$"


class SqlError(ValueError):
    """A statement that cannot be read."""


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    of: tuple


@dataclass
class Statement:
    columns: list[str] | None = None  # None: *
    count: bool = False
    where: object = None
    group: list[str] = field(default_factory=list)
    order: str | None = None
    descending: bool = False
    limit: int = DEFAULT_LIMIT


def tokenise(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SqlError(f"cannot read {text[at:at + 12]!r}")
        kind = m.lastgroup
        word = m[kind]
        if kind == "str":
            word = word[1:-1].replace("''", "'") if word[0] == "'" else word[1:-1]
        out.append((kind, word))
        at = m.end()
    return out


class _Parser:
    def __init__(self, toks: list[tuple[str, str]]) -> None:
        self.toks, self.at = toks, 0

    def key(self, *words: str) -> bool:
        """Consume the reserved words if they come next."""
        for i, w in enumerate(words):
            if self.at + i >= len(self.toks) or self.toks[self.at + i][0] != "word" or self.toks[self.at + i][1].upper() != w:
                return False
        self.at += len(words)
        return True

    def sym(self, s: str) -> bool:
        if self.at < len(self.toks) and self.toks[self.at] == ("sym", s):
            self.at += 1
            return True
        return False

    def need(self, ok: bool, what: str) -> None:
        if not ok:
            got = self.toks[self.at][1] if self.at < len(self.toks) else "the end"
            raise SqlError(f"{what} expected, not {got!r}")

    def word(self, what: str, reserved_ok: bool = False) -> str:
        ok = self.at < len(self.toks) and self.toks[self.at][0] in ("word", "str")
        self.need(ok, what)
        kind, w = self.toks[self.at]
        if kind == "word" and not reserved_ok and w.upper() in RESERVED:
            raise SqlError(f"{what} expected, not {w!r}")
        self.at += 1
        return w

    def names(self, what: str, reserved_ok: bool = False) -> list[str]:
        out = [self.word(what, reserved_ok)]
        while self.sym(","):
            out.append(self.word(what, reserved_ok))
        return out

    def expr(self):
        parts = [self.conj()]
        while self.key("OR"):
            parts.append(self.conj())
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def conj(self):
        parts = [self.neg()]
        while self.key("AND"):
            parts.append(self.neg())
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def neg(self):
        if self.key("NOT"):
            return Logic("not", (self.neg(),))
        if self.sym("("):
            inner = self.expr()
            self.need(self.sym(")"), "a closing parenthesis")
            return inner
        col = self.word("a column")
        self.need(self.at < len(self.toks) and self.toks[self.at][0] == "op", "an operator")
        op = self.toks[self.at][1]
        self.at += 1
        return Compare(col, "!=" if op == "<>" else op, self.word("a value"))

    def statement(self) -> Statement:
        s = Statement()
        if not self.toks:
            raise SqlError("empty statement")
        if not self.key("SELECT"):
            self.key("WHERE")
            s.where = self.expr()
            self.need(self.at == len(self.toks), "the end")
            return s
        if self.key("COUNT"):
            self.need(self.sym("(") and self.sym("*") and self.sym(")"), "(*)")
            s.count = True
        elif not self.sym("*"):
            s.columns = self.names("a column")
        if self.key("FROM"):
            self.word("a table")
        if self.key("WHERE"):
            s.where = self.expr()
        if self.key("GROUP", "BY"):
            s.group = self.names("a column", True)
        if self.key("ORDER", "BY"):
            s.order = self.word("a column", True)
            s.descending = self.key("DESC")
            if not s.descending:
                self.key("ASC")
        if self.key("LIMIT"):
            n = self.word("a number")
            if not n.isdigit():
                raise SqlError(f"LIMIT {n} is no number of rows")
            s.limit = max(1, min(MAX_LIMIT, int(n)))
        self.need(self.at == len(self.toks), "the end")
        return s


def parse(text: str) -> Statement:
    return _Parser(tokenise(text)).statement()


# ---- compilation ----


def resolve(name: str) -> Column:
    """A column by name in any case: the built-ins line, file and the time as written, else a field; missing means empty."""
    n = name.lower()
    if n == "line":
        return F.col("line").cast("string")
    if n == "file":
        return present(F.col("file"))
    own = present(F.element_at("fields", n))
    if n in ("ts", "timestamp", "time"):
        return F.when(present(F.col("ts_raw")) != "", F.col("ts_raw")).otherwise(own)
    return own


def compare(left: Column, op: str, value: str) -> Column:
    """A comparison; the literal decides at plan time which kinds are possible."""
    if op in ("=", "!="):
        same = ascii_lower(left) == ascii_fold(value)
        return same if op == "=" else ~same
    if op in ("~", "!~"):
        has = ascii_lower(left).contains(ascii_fold(value))
        return has if op == "~" else ~has
    do = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}[op]
    out = do(ascii_lower(left), F.lit(ascii_fold(value)))
    if (s := seconds_of(value.strip())) is not None:
        at = prefix_seconds(F.trim(left))
        out = F.when(at.isNotNull(), do(at, F.lit(s))).otherwise(out)
    if _NUMBER.fullmatch(value):
        n = float(value)
        num = F.trim(left).try_cast("double")
        numeric = F.lit(False) if math.isnan(n) else do(num, F.lit(n)) & ~F.isnan(num)
        out = F.when(left.rlike(_NUMBER_SQL), numeric).otherwise(out)
    return out


def condition(node) -> Column:
    if isinstance(node, Compare):
        if node.column.lower() == "line" and _NUMBER.fullmatch(node.value) and node.op in (">", "<", ">=", "<=", "=", "!="):
            n, line = float(node.value), F.col("line")
            return {"=": line == n, "!=": line != n, ">": line > n, "<": line < n, ">=": line >= n, "<=": line <= n}[node.op]
        return compare(resolve(node.column), node.op, node.value)
    parts = [condition(x) for x in node.of]
    if node.op == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.op == "and" else out | p
    return out


def rows(lines: DataFrame, parser: Parser | None = None) -> DataFrame:
    """Parsed lines as rows of the dialect: file, line, ts, ts_raw, fields under lower-case names."""
    return as_rows(records(lines, parser))


def as_rows(recs: DataFrame) -> DataFrame:
    # a generator, not a projection: the map is built once a row, however many conditions look into it
    return recs.select("file", "line", "ts", "ts_raw", F.explode(F.array(lowered(F.col("fields"), F.col("level"), F.col("msg")))).alias("fields"))


def required(node) -> list[str] | None:
    """Literals of which every matching line must hold one, in any ASCII case; None if there are none. Values that a parser
    makes up (``-``) and numbers and times, which compare by value, are not among them."""
    if isinstance(node, Compare):
        plain = node.column.lower() not in ("line", "file") and node.op in ("=", "~") and node.value not in ("", "-") and node.value.isascii() and node.value.isprintable() and "\\" not in node.value and '"' not in node.value
        return [ascii_fold(node.value)] if plain else None
    parts = [required(x) for x in node.of] if node is not None else []
    if not parts or node.op == "not":
        return None
    if node.op == "and":
        known = [p for p in parts if p]
        return max(known, key=lambda p: min(map(len, p))) if known else None
    return [w for p in parts for w in p] if all(parts) else None


def query(statement: str | Statement, lines: DataFrame, parser: Parser | None = None, extra: list[str] | None = None, scan: int | None = None) -> DataFrame:
    """Result of a statement over unparsed lines. Lines without a literal that the statement requires are left out before they
    are parsed (but for escaped ones, whose text differs from their fields), where the lines themselves are not returned or counted."""
    s = parse(statement) if isinstance(statement, str) else statement
    if words := required(s.where):
        text = F.lower(present(F.col("text")))
        some = text.contains("\\")
        for w in words:
            some = some | text.contains(w)
        lines = lines.where(some)
    return run(s, rows(lines, parser), extra, scan)


def run(statement: str | Statement, src: DataFrame, extra: list[str] | None = None, scan: int | None = None) -> DataFrame:
    """Result of a statement over rows(). ``extra``: custom columns shown by ``*``; ``scan``: read only the first so many lines of each file."""
    s = parse(statement) if isinstance(statement, str) else statement
    if scan is not None:
        src = src.where(F.col("line") <= scan)
    if s.where is not None:
        src = src.where(condition(s.where))
    if s.group:
        keys = list(dict.fromkeys(g.lower() for g in s.group))
        out = src.select(*[resolve(k).alias(k) for k in keys]).groupBy(*keys).agg(F.count("*").alias("count"))
        ties = [F.col(k) for k in keys]
        if s.order and s.order.lower() in keys:
            k = F.col(s.order.lower())
            order = [k.desc() if s.descending else k.asc(), *ties]
        elif s.order and s.order.lower() == "count":
            order = [F.desc("count") if s.descending else F.asc("count"), *ties]
        else:
            order = [F.desc("count"), *ties]
        return out.orderBy(*order).limit(s.limit)
    if s.count:
        return src.agg(F.count("*").alias("count"))
    if s.columns is None:
        shown = ["ts", "level", "msg", *(c.lower() for c in extra or [])]
    else:
        shown = [c.lower() for c in s.columns if c.lower() not in ("line", "file")]
    cols = [resolve(c).alias(c) for c in dict.fromkeys(shown)]
    return src.orderBy("file", "line").limit(s.limit).select("line", "file", *cols)


def statistics(statement: str | Statement, src: DataFrame, scan: int | None = None) -> DataFrame:
    """One row: ``scanned, matched, truncated_rows, truncated_scan`` of a statement; with ``scan`` only the first so many lines of each file are looked at."""
    s = parse(statement) if isinstance(statement, str) else statement
    hit = condition(s.where) if s.where is not None else F.lit(True)
    inside = F.col("line") <= scan if scan is not None else F.lit(True)
    out = src.agg(F.count_if(inside).alias("scanned"), F.count_if(inside & hit).alias("matched"), F.coalesce(F.bool_or(~inside), F.lit(False)).alias("truncated_scan"))
    return out.select("scanned", "matched", (F.lit(False) if s.count else F.col("matched") > s.limit).alias("truncated_rows"), "truncated_scan")


def bars(groups: DataFrame, key: str, width: int = 28, most: int = 20) -> DataFrame:
    """The largest groups with a bar in proportion to the largest one."""
    top = groups.orderBy(F.desc("count"), key).limit(most)
    biggest = top.agg(F.max("count").alias("__max"))
    return top.crossJoin(F.broadcast(biggest)).select(key, "count", F.repeat(F.lit("█"), F.round(F.col("count") / F.col("__max") * width).cast("int")).alias("bar"))  # one row: the largest count
