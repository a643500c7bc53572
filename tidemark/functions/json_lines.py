"""JSON lines: strict top-level fields as text, and a one-line display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import bind
from .text import clipped

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# The field names that hold level, message and time, by priority.
LEVEL_KEYS = ["level", "severity", "lvl", "loglevel"]
MESSAGE_KEYS = ["msg", "message", "text", "error", "event"]
TIME_KEYS = ["timestamp", "time", "ts", "@timestamp", "datetime", "date"]


def _objects(t: Column) -> Column:
    """The text read as the only items of an array; null if that is no JSON."""
    return F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<map<string,string>>", _STRICT)


def _one(t: Column, objects: Column) -> Column:
    """Whether the items are exactly one object. The parser alone accepts trailing text; within the array only text that closes
    it early can follow, for which alone the text is read once more, inside an object."""
    inside = F.from_json(F.concat(F.lit('{"w":'), t, F.lit("}")), "w map<string,string>", _STRICT)["w"].isNotNull()
    return F.coalesce((F.size(objects) == 1) & F.when(t.rlike(r"\}\s*\]\s*,"), inside).otherwise(True), F.lit(False))


def is_object(text: Column) -> Column:
    """Whether the line is exactly one JSON object."""
    return bind(F.trim(text), lambda t: F.when(t.startswith("{") & t.endswith("}"), bind(_objects(t), lambda o: _one(t, o))).otherwise(False))


def json_fields(text: Column) -> Column:
    """Non-null top-level fields as text (objects and arrays as compact JSON), or null if the line is no object or has none. The text is parsed once."""

    def fields(t: Column) -> Column:
        kept = lambda o: F.map_filter(F.get(o, F.lit(0)), lambda _, v: v.isNotNull())
        full = lambda m: F.when(F.size(m) > 0, m)
        return F.when(t.startswith("{") & t.endswith("}"), bind(_objects(t), lambda o: F.when(_one(t, o), bind(kept(o), full))))

    return bind(F.trim(text), fields)


def pick(fields: Column, keys: list[str]) -> Column:
    """Value of the first of the keys that occurs in any ASCII case."""

    def value(entries: Column, key: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["k"] == key), F.lit(0))["v"]

    lowered = F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    return bind(lowered, lambda es: F.coalesce(*[value(es, k) for k in keys]))


def display(text: Column) -> Column:
    """``[time] LEVEL message k=v ...`` with clipped parts and at most six further fields; null if the line is no object."""
    named = [k.lower() for k in TIME_KEYS + LEVEL_KEYS + MESSAGE_KEYS]

    def shown(f: Column) -> Column:
        rest = F.array_sort(F.filter(F.map_entries(f), lambda e: ~F.lower(e["key"]).isin(named)))
        time = pick(f, TIME_KEYS)

        def parts(r: Column) -> Column:
            extra = F.transform(F.slice(r, 1, 6), lambda e: F.concat(clipped(e["key"], 24), F.lit("="), clipped(e["value"], 48)))
            return F.concat_ws(
                " ",
                F.when(time.isNotNull(), F.concat(F.lit("["), clipped(time, 32), F.lit("]"))),
                clipped(F.upper(pick(f, LEVEL_KEYS)), 12),
                clipped(pick(f, MESSAGE_KEYS), 120),
                F.when(F.size(r) > 0, F.array_join(extra, " ")),
                F.when(F.size(r) > 6, F.lit("\u2026")),
            )

        return bind(rest, parts)

    return bind(json_fields(text), lambda f: F.when(f.isNotNull(), shown(f)))
