"""Token filters: words that must occur, ``-word`` that must not, ``key=value`` and ``-key=value`` on JSON lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_lines import json_fields
from .text import ascii_fold, ascii_lower, present


@dataclass
class TokenFilter:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)
    not_fields: list[tuple[str, str]] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.include or self.exclude or self.fields or self.not_fields)


def parse(text: str) -> TokenFilter:
    """A lone ``-`` is ignored; ``=x`` and ``k=`` are plain words."""
    out = TokenFilter()
    for tok in text.split():
        negated = tok.startswith("-")
        body = tok[1:] if negated else tok
        if not body:
            continue
        k, eq, v = body.partition("=")
        if eq and k and v:
            (out.not_fields if negated else out.fields).append((k, v))
        else:
            (out.exclude if negated else out.include).append(body)
    return out


def field_is(obj: Column, key: str, value: str) -> Column:
    """Whether any field of a JSON line has this key and value (ASCII case-insensitive); false for other lines."""
    k, v = ascii_fold(key), ascii_fold(value)
    return F.coalesce(F.exists(F.map_entries(obj), lambda e: (ascii_lower(e["key"]) == k) & (ascii_lower(e["value"]) == v)), F.lit(False))


def condition(query: str | TokenFilter, text: Column, sensitive: bool = False) -> Column:
    """All words, no excluded word, all fields, no excluded field. Words come first: they are cheap and reach the scan."""
    f = parse(query) if isinstance(query, str) else query
    t = present(text) if sensitive else F.lower(present(text))
    fold = (lambda w: w) if sensitive else str.lower
    parts = [t.contains(fold(w)) for w in f.include] + [~t.contains(fold(w)) for w in f.exclude]
    if f.fields or f.not_fields:
        obj = json_fields(text)
        parts += [field_is(obj, k, v) for k, v in f.fields] + [~field_is(obj, k, v) for k, v in f.not_fields]
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
