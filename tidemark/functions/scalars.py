"""Scalar helpers: base64, JWT, JSON, SQL tidy, hashes, hex dumps, formats, names."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import bind
from .text import present

# Keywords which the SQL tidy writes in capitals, and those which start a line.
SQL_WORDS = ["SELECT", "INSERT INTO", "UPDATE", "DELETE FROM", "VALUES", "FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING", "JOIN", "LEFT JOIN", "RIGHT JOIN", "INNER JOIN", "ON", "UNION", "SET"]
SQL_LINES = ["FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING", "VALUES", "UNION", "JOIN"]


def base64_text(c: Column) -> Column:
    """Decoded text of base64 in either alphabet, padded or not, white space ignored; broken bytes become U+FFFD, bad input null."""
    b = F.translate(F.regexp_replace(present(c), r"[\s=]+", ""), "-_", "+/")
    padded = F.rpad(b, F.length(b) + F.pmod(-F.length(b), F.lit(4)), "=")
    fine = b.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(b) % 4 != 1)
    return F.when(fine, F.make_valid_utf8(F.unbase64(padded).cast("string")))


def jwt_parts(c: Column) -> Column:
    """``header, payload`` of a token as JSON with two spaces; null if it has not two or three parts or one of both is no JSON."""
    p = F.split(F.trim(present(c)), r"\.")
    part = lambda i: json_pretty(base64_text(F.get(p, F.lit(i))))
    both = F.struct(part(0).alias("header"), part(1).alias("payload"))
    return F.when(F.size(p).between(2, 3) & both["header"].isNotNull() & both["payload"].isNotNull(), both)


def jwt_text(c: Column) -> Column:
    """The same as one text, each part under a heading."""
    return bind(jwt_parts(c), lambda j: F.when(j.isNotNull(), F.concat(F.lit("== header ==\n"), j["header"], F.lit("\n== payload ==\n"), j["payload"], F.lit("\n"))))


def _by_value(fn, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x != x else fn(x))

    return run


def _no_constant(name: str):
    raise ValueError(name)


def pretty_json(text: str) -> str | None:
    """JSON with two spaces; null if it does not parse."""
    try:
        return json.dumps(json.loads(text, parse_constant=_no_constant), indent=2, ensure_ascii=False)
    except ValueError:
        return None


def tidy_sql(text: str) -> str:
    """Keywords in capitals and clauses on their own lines, outside single quotes; no parser."""
    parts = re.split(r"('[^']*'?)", text)
    word = re.compile(r"\b(?:" + "|".join(sorted(SQL_WORDS, key=len, reverse=True)) + r")\b", re.IGNORECASE)
    out = "".join(p if i % 2 else word.sub(lambda m: m[0].upper(), p) for i, p in enumerate(parts))
    out = re.sub(r"[ \t]+(" + "|".join(SQL_LINES) + r")\b", r"\n\1", out)
    out = "\n".join(x.rstrip() for x in out.splitlines())
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def short_hash(text: str) -> str:
    """Eight hex digits: both halves of FNV-1a combined."""
    h = fnv1a(text.encode())
    return f"{(h >> 32) ^ (h & 0xFFFFFFFF):08x}"


def json_pretty(c: Column) -> Column:
    return _by_value(pretty_json)(c)


def sql_tidy(c: Column) -> Column:
    return _by_value(tidy_sql)(c)


def line_hash(c: Column) -> Column:
    return _by_value(short_hash)(c)


def hex_rows(data: Column, offset: int = 0) -> Column:
    """Hex dump rows of a binary: offset, 16 bytes in two halves, printable characters."""
    n = F.octet_length(data)

    def row(i: Column) -> Column:
        piece = F.substr(data, i * 16 + 1, F.lit(16))
        byte = lambda k: F.lower(F.hex(F.substr(piece, F.lit(k + 1), F.lit(1))))
        cells = [F.when(F.octet_length(piece) > k, F.concat(byte(k), F.lit(" "))).otherwise("   ") for k in range(16)]
        chars = [F.when(F.octet_length(piece) > k, F.when(byte(k).between("20", "7e"), F.decode(F.substr(piece, F.lit(k + 1), F.lit(1)), "US-ASCII")).otherwise(".")).otherwise("") for k in range(16)]
        return F.concat(F.lpad(F.lower(F.hex(i * 16 + offset)), 8, "0"), F.lit(": "), *cells[:8], F.lit(" "), *cells[8:], F.lit(" |"), *chars, F.lit("|"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), row)).otherwise(F.array().cast("array<string>"))


def count_text(c: Column) -> Column:
    """A number with dots between thousands."""
    return F.translate(F.format_number(c.cast("long"), 0), ",", ".")


def size_text(c: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal and a comma."""
    unit = lambda k, name: F.concat(F.format_string("%.1f", c / float(1024**k)), F.lit(" " + name))
    out = F.when(c >= 1024**3, unit(3, "GB")).when(c >= 1024**2, unit(2, "MB")).when(c >= 1024, unit(1, "KB")).otherwise(F.concat(c.cast("string"), F.lit(" B")))
    return F.translate(out, ".", ",")


def size_of_bytes(n: int) -> str:
    """The same for one number, on the driver."""
    for k, name in ((3, "GB"), (2, "MB"), (1, "KB")):
        if n >= 1024**k:
            return f"{n / 1024**k:.1f} {name}".replace(".", ",")
    return f"{n} B"


def safe_name(c: Column) -> Column:
    """A file name of letters, digits, ``-`` and ``_``: others dropped, blanks to dashes, lower case, at most 40."""
    kept = F.trim(F.regexp_replace(present(c), "[^A-Za-z0-9_ -]", ""))
    return F.lower(F.left(F.translate(kept, " ", "-"), F.lit(40)))


def word_at(text: str, column: int) -> str:
    """The run of letters, digits and ``_`` around a column."""
    return next((m[0] for m in re.finditer(r"\w+", text) if m.start() <= column <= m.end()), "")


def version_key(text: str) -> tuple:
    """Sort key of a version such as ``v1.2.3-beta``: numbers, then pre-releases before releases."""
    m = re.match(r"v?(\d+(?:\.\d+)*)(?:[-+](.*))?$", text.strip())
    if not m:
        return ((), 0, text)
    return tuple(map(int, m[1].split("."))), 0 if m[2] and "-" in text else 1, m[2] or ""
