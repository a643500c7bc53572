"""Schema on read: lines -> records (JSON, SQL trace, generic, or a user's pattern).

A record is ``kind, ts_raw, ts, level, msg, fields map<string,string>``; ``ts`` is in seconds. Each kind is one regex whose
groups are written out in one pass and cut in the JVM. Under ``auto`` a line is tried as JSON, SQL trace and generic, in
this order, line by line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_lines
from ..functions.instants import bind
from ..functions.text import group_names, java_regex, present
from ..functions.timestamps import PREFIX, prefix_seconds
from . import schema_drift

# The verbs of SQL traces and the level words of generic lines.
ACTIONS = "SELECT INSERT UPDATE DELETE MERGE COMMIT ROLLBACK CHECKPOINT TRANSACTION EXECUTE CALL CREATE ALTER DROP TRUNCATE BEGIN".split()
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL"]
RECORD = "struct<kind:string,ts_raw:string,ts:bigint,level:string,msg:string,fields:map<string,string>>"
_SEP = "\u0001"
_STAMP = re.sub(r"\((?!\?)", "(?:", PREFIX[1:])
_LVL = "(?i:" + "|".join(sorted(LEVELS, key=len, reverse=True)) + ")"
_ACT = "(?i:" + "|".join(ACTIONS) + ")"
_GENERIC = rf"(?s)^(?:\[\s*({_STAMP}[^\]]*?)\s*\]\s*|({_STAMP}(?:[.,]\d+)?)(?:$|(?=\[)|[ \t]+))(?:\[\s*({_LVL})\s*\]\s*|({_LVL})(?:\s+|$)|\[\s*\]\s*)?(.*)$"
_TRACE = rf"(?s)^(?:\[(\d{{4}}[^\]]{{6,}})\]|(\d{{4}}-.{{14}}(?:\.\d*)?))\s*(?=.)(?:\[([^\]]*)\]\s*|\(([^)]*)\)\s*|((?:session|sid|user)=\S*)\s+)?(?:({_ACT})(?:\s+|$)|\S+\s+({_ACT})\s+)?(.*)$"


def _groups(text: Column, pattern: str, *outs: str) -> Column:
    """Groups of one match written out in order (unmatched ones are empty), or null."""
    done = F.regexp_replace(text, pattern, _SEP + _SEP.join(outs))
    return F.when(done.startswith(_SEP), F.split(done, _SEP))


def trimmed(text: Column) -> Column:
    return F.btrim(present(text), F.lit(" \t\r\n\x0b\x0c"))


def key_values(msg: Column, most: int = 8) -> Column:
    """``k=v`` words of a message: keys of at most 32 letters, digits, ``_`` and ``-``; values not empty, quotes trimmed; the first ``most``."""
    words = F.regexp_extract_all(msg, F.lit(r"(?<!\S)[A-Za-z0-9_-]{1,32}=\S+"), F.lit(0))
    pair = lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(F.substr(w, F.instr(w, "=") + 1), "^[\"']+|[\"']+$", "").alias("v"))
    return F.when(msg.contains("="), F.transform(F.slice(words, 1, most), pair)).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def first_wins(entries: Column) -> Column:
    """A map of (k, v) structs in which the first of equal keys wins."""

    def kept(es: Column, ks: Column) -> Column:
        once = F.size(F.array_distinct(ks)) == F.size(ks)
        return F.when(once, F.map_from_entries(es)).otherwise(F.map_from_entries(F.filter(es, lambda e, i: F.array_position(ks, e["k"]) == i + 1)))

    return bind(entries, lambda es: bind(F.transform(es, lambda e: e["k"]), lambda ks: kept(es, ks)))


def _record(kind: str, ts_raw: Column, level: Column, msg: Column, fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), ts_raw.alias("ts_raw"), prefix_seconds(F.trim(ts_raw)).alias("ts"), level.cast("string").alias("level"), msg.alias("msg"), fields.alias("fields"))


def _pairs(*named: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in named])


def parse_json(text: Column) -> Column:
    """Record of a JSON object line; null for anything else. The time is the first field, by name, of those that may hold it."""

    def build(f: Column) -> Column:
        stamped = F.filter(F.array_sort(F.map_entries(f)), lambda e: F.lower(e["key"]).isin(json_lines.TIME_KEYS))
        return _record("json", F.get(stamped, F.lit(0))["value"], json_lines.pick(f, json_lines.LEVEL_KEYS), json_lines.pick(f, json_lines.MESSAGE_KEYS), f)

    return bind(trimmed(text), lambda t: F.when(t.startswith("{"), bind(json_lines.json_fields(t), lambda f: F.when(f.isNotNull(), build(f)))))


def parse_sql_trace(text: Column) -> Column:
    """Record of a database trace line (time, session, verb, rest); null without a session and a verb."""

    def build(g: Column) -> Column:
        ts, session, action, query = (F.get(g, i) for i in range(1, 5))
        s = F.when(session == "", "-").otherwise(session)
        a = F.when(action == "", "-").otherwise(F.upper(action))
        base = _pairs(("ts", ts), ("session", s), ("action", a), ("query", query))
        return F.when((s != "-") | (a != "-"), _record("sql", ts, F.lit(None), query, first_wins(F.concat(base, key_values(query, 6)))))

    return bind(trimmed(text), lambda t: F.when(F.octet_length(t) >= 12, bind(_groups(t, _TRACE, "$1$2", "$3$4$5", "$6$7", "$8"), lambda g: F.when(g.isNotNull(), build(g)))))


def parse_generic(text: Column) -> Column:
    """Record of ``TIME LEVEL message`` and ``[TIME] [LEVEL] message``; the level may be missing."""

    def build(g: Column) -> Column:
        ts, level, msg = (F.get(g, i) for i in range(1, 4))
        lvl = F.when(level != "", level)
        base = F.filter(_pairs(("ts", ts), ("level", lvl), ("msg", msg)), lambda e: e["v"].isNotNull())
        return _record("generic", ts, lvl, msg, first_wins(F.concat(base, key_values(msg, 8))))

    return bind(trimmed(text), lambda t: F.when(F.octet_length(t) >= 12, bind(_groups(t, _GENERIC, "$1$2", "$3$4", "$5"), lambda g: F.when(g.isNotNull(), build(g)))))


def parse_auto(text: Column) -> Column:
    """JSON, else SQL trace, else generic, else null."""
    return F.coalesce(parse_json(text), parse_sql_trace(text), parse_generic(text))


# ---- user patterns ----


@dataclass(frozen=True)
class Parser:
    """A named pattern: a regex with named groups, or with the shorthand ``{TS} {LVL} {MSG} {name} {name:regex}``."""

    name: str
    pattern: str

    def expanded(self) -> str:
        return expand(self.pattern)

    def fields(self) -> list[str]:
        """Names of its groups; ValueError if it has no name, does not compile or has no named group."""
        if not self.name.strip():
            raise ValueError("a parser needs a name")
        import regex

        try:
            regex.compile(self.expanded())
        except regex.error as e:
            raise ValueError(f"the pattern does not compile: {e}") from None
        names = [n for n, _ in group_names(self.expanded())]
        if not names:
            raise ValueError("the pattern has no named group")
        return names


def expand(pattern: str) -> str:
    """Shorthand written out; quantifiers such as ``{2,3}`` stay."""
    short = {"TS": f"(?P<ts>{schema_drift.TS_GROUP})", "LVL": f"(?P<level>{schema_drift.LVL_GROUP})", "MSG": f"(?P<msg>{schema_drift.MSG_GROUP})"}

    def one(m: re.Match) -> str:
        name, rx = m[1], m[2]
        if rx == "":
            raise ValueError(f"group {name!r} has no pattern")
        return short[name] if rx is None and name in short else f"(?P<{name}>{rx if rx is not None else schema_drift.ANY_GROUP})"

    return re.sub(r"\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}", one, pattern)


#: ready-made parsers; brackets are written as brackets, so that they match bracketed lines
BUILTIN = [
    Parser("java", "{TS} {LVL} {MSG}"),
    Parser("bracket", r"\[{ts:.+?}\] \[{level:.+?}\] {MSG}"),
    Parser("apache combined", r'{host} {ident} {user} \[{ts:.+?}\] "{request:.+?}" {status} {size}'),
    Parser("syslog", "{TS} {host} {proc} {MSG}"),
]


def parse_custom(text: Column, parser: Parser) -> Column:
    """Record of a user's pattern (found anywhere in the line); null where it does not match. Unmatched optional groups are no fields."""
    parser.fields()
    rx = parser.expanded()
    groups = group_names(rx)
    java = "(?s)^.*?" + java_regex(rx) + ".*$"
    t = present(text)

    def build(g: Column) -> Column:
        entries = F.array(*[F.struct(F.lit(n).alias("k"), F.get(g, i + 1).alias("v")) for i, (n, _) in enumerate(groups)])
        return F.filter(entries, lambda e: e["v"] != "")

    def pick(entries: Column, keys: list[str]) -> Column:
        return F.get(F.filter(entries, lambda e: F.lower(e["k"]).isin(keys)), F.lit(0))["v"]

    def record(e: Column) -> Column:
        return _record("custom", pick(e, json_lines.TIME_KEYS), pick(e, json_lines.LEVEL_KEYS), pick(e, ["msg", "message", "text"]), first_wins(e))

    return bind(_groups(t, java, *[f"${n}" for _, n in groups]), lambda g: F.when(g.isNotNull(), bind(build(g), record)))


# ---- records and rows ----


def records(lines: DataFrame, parser: Parser | None = None) -> DataFrame:
    """``file, line, (byte,) text`` and the record's columns. Under auto, lines which no parser reads stay, as their own message
    of kind ``plain``; with a user's parser they are left out."""
    keep = [c for c in ("file", "line", "byte", "text") if c in lines.columns]
    # a generator, not a projection: each line is parsed once, whatever later conditions use
    if parser:
        rec = F.array_compact(F.array(parse_custom(F.col("text"), parser)))
    else:
        plain = _record("plain", F.lit(None).cast("string"), F.lit(None), F.col("text"), F.create_map(F.lit("msg"), present(F.col("text"))))
        rec = F.array(F.coalesce(parse_auto(F.col("text")), plain))
    return lines.select(*keep, F.inline(rec))


def lowered(fields: Column, level: Column, msg: Column) -> Column:
    """Fields under lower-case names (the first of equal ones wins), with level and message added where missing."""
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    extra = F.filter(_pairs(("level", level), ("msg", msg)), lambda e: e["v"].isNotNull())
    built = first_wins(F.concat(F.coalesce(entries, F.array().cast("array<struct<k:string,v:string>>")), extra))
    # most records have all of it already
    names = F.array_join(F.map_keys(fields), "\u0001")
    as_is = (names == F.lower(names)) & (level.isNull() | F.map_contains_key(fields, F.lit("level"))) & (msg.isNull() | F.map_contains_key(fields, F.lit("msg")))
    return F.when(as_is, fields).otherwise(built)


_ALIASES = [["ts", "timestamp", "time", "datetime", "date"], json_lines.LEVEL_KEYS, json_lines.MESSAGE_KEYS]


def lookup(fields: Column, name: str) -> Column:
    """Field by name in any ASCII case, then by the aliases of time, level and message."""
    alias = next((a for a in _ALIASES if name.lower() in a[: 5 if a is _ALIASES[0] else 3]), [])
    return json_lines.pick(fields, [name.lower(), *alias])


def detect(lines: DataFrame) -> DataFrame:
    """``file, format, percent, n_lines, n_json, n_sql, n_generic``: how many of a file's non-blank lines each parser reads,
    every line counted for the first of JSON, SQL trace and generic that reads it. ``format`` is the first of them with at
    least half of the lines, else ``plain`` with the largest share."""
    t = F.col("text")
    kind = F.when(parse_json(t).isNotNull(), "j").when(parse_sql_trace(t).isNotNull(), "s").when(parse_generic(t).isNotNull(), "g").otherwise("p")
    n = lines.where(F.trim(present(t)) != "").select("file", F.explode(F.array(kind)).alias("k"))
    c = n.groupBy("file").agg(F.count("*").alias("n_lines"), *[F.count_if(F.col("k") == x).alias(y) for x, y in (("j", "n_json"), ("s", "n_sql"), ("g", "n_generic"))])
    half = lambda x: F.col(x) * 2 >= F.col("n_lines")
    name = F.when(half("n_json"), "json").when(half("n_sql"), "sql").when(half("n_generic"), "generic").otherwise("plain")
    hit = F.when(half("n_json"), F.col("n_json")).when(half("n_sql"), F.col("n_sql")).when(half("n_generic"), F.col("n_generic")).otherwise(F.greatest("n_json", "n_sql", "n_generic"))
    return c.select("file", name.alias("format"), F.floor(hit * 100 / F.col("n_lines")).cast("long").alias("percent"), "n_lines", "n_json", "n_sql", "n_generic")


# ---- line classes ----


def severity(text: Column) -> Column:
    """error, warn, info or normal by case-sensitive words."""
    t = present(text)
    return F.when(t.contains("ERROR") | t.contains("FATAL") | t.contains("Exception") | t.contains("Caused by:"), "error").when(t.contains("WARN"), "warn").when(t.contains("INFO"), "info").otherwise("normal")


def is_stack_line(text: Column) -> Column:
    return present(text).rlike(r"^[ \t]*(?:at |\.\.\. )")


def keywords(text: Column) -> Column:
    """Severity words of a line in order, the longest first where several begin at one place."""
    return F.regexp_extract_all(present(text), F.lit(_KEYWORDS), F.lit(1))


_KEYWORDS = "(Caused by:|Exception|WARNING|ERROR|FATAL|WARN)"


def keyword_spans(text: Column) -> Column:
    """``array<struct<start:int,end:int,word:string>>``: the severity words with their byte columns."""
    from .search import spans

    return spans(present(text), _KEYWORDS)


@dataclass(frozen=True)
class Rule:
    """A highlight rule: literal or regex, case, whole line or match only, each value in a shade of its own."""

    name: str
    pattern: str
    regex: bool = False
    sensitive: bool = False
    whole_line: bool = False
    variants: bool = False

    def java(self) -> str:
        from ..functions.text import quoted

        return ("" if self.sensitive else "(?iu)") + (java_regex(self.pattern) if self.regex else quoted(self.pattern))

    def groups(self) -> int:
        """Capture groups of the pattern; if it has some, they are highlighted and not the whole match."""
        import regex

        return regex.compile(self.pattern).groups if self.regex else 0


def highlight(text: Column, rules: list[Rule]) -> Column:
    """Name of the first rule that applies, or null."""
    from .search import literal_condition, regex_condition

    out = F.lit(None).cast("string")
    for r in reversed(rules):
        hit = regex_condition(text, r.pattern, r.sensitive) if r.regex else literal_condition(text, r.pattern, r.sensitive)
        out = F.when(hit, r.name).otherwise(out)
    return out


def highlight_spans(text: Column, rules: list[Rule]) -> Column:
    """``array<struct<rule:string,start:int,end:int,word:string,shade:int>>`` of every rule that applies, in the order of the
    rules: the whole line for a ``whole_line`` rule, else its matches (byte columns). ``shade`` is 0 without ``variants``."""
    from ..functions.text import byte_length
    from .search import spans

    t = present(text)
    out = []
    for r in rules:
        if not r.pattern:
            continue
        if r.whole_line:
            found = F.when(t.rlike(r.java()), F.array(F.struct(F.lit(0).alias("start"), byte_length(t).alias("end"), t.alias("word"))))
        elif r.groups():
            found = _group_spans(r)(t)
        else:
            found = spans(t, r.java())
        found = F.coalesce(found, F.array().cast("array<struct<start:int,end:int,word:string>>"))
        out.append(_labelled(found, r))
    return F.concat(*out) if out else F.array().cast("array<struct<rule:string,start:int,end:int,word:string,shade:int>>")


def _labelled(found: Column, rule: Rule) -> Column:
    shade = variant if rule.variants else lambda _: F.lit(0)
    return F.transform(found, lambda s: F.struct(F.lit(rule.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["word"].alias("word"), shade(s["word"]).alias("shade")))


def _group_spans(rule: Rule):
    """Spans of a pattern's capture groups, by Arrow batches: the JVM tells no places of groups."""

    @F.pandas_udf("array<struct<start:int,end:int,word:string>>")
    def run(texts: pd.Series) -> pd.Series:
        import regex

        rx = regex.compile(rule.pattern, 0 if rule.sensitive else regex.IGNORECASE)

        def one(t: str) -> list[dict]:
            places = (m.span(g) for m in rx.finditer(t) for g in range(1, rx.groups + 1))
            return [{"start": len(t[:a].encode()), "end": len(t[:z].encode()), "word": t[a:z]} for a, z in places if z > a >= 0]

        return texts.map(one)

    return run


def variant(value: Column, n: int = 5) -> Column:
    """Deterministic shade 0..n-1 of a value: 32-bit FNV-1a of its bytes, modulo n."""
    data = F.encode(present(value), "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    at = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return (F.aggregate(at, F.lit(2166136261).cast("long"), step) % n).cast("int")


def result_row(rank: Column, line: Column, ts_raw: Column, text: Column) -> Column:
    """``#n  line N  [time] snippet`` with at most 90 characters of the line."""
    from ..functions.text import clipped

    stamp = F.when(present(ts_raw) != "", F.concat(F.lit("["), ts_raw, F.lit("] "))).otherwise("")
    return F.concat(F.lit("#"), rank.cast("string"), F.lit("  line "), line.cast("string"), F.lit("  "), stamp, clipped(F.trim(present(text)), 90))
