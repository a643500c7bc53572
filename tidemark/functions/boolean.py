"""Boolean queries: terms, "phrases", -x, NOT, AND/NAND, OR/NOR/XOR and parentheses, compiled to one Column.

NOT binds closest, then AND, NAND and juxtaposition, then OR, NOR and XOR; operators of one level group to the left.
A term holds if the line contains it. XOR of several operands is odd parity. Empty terms are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present


class QueryError(ValueError):
    """A query that cannot be read."""


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Many:
    """``kind`` is and, or, xor."""

    kind: str
    of: tuple


_WORDS = {"and": "and", "or": "or", "xor": "xor", "nand": "nand", "nor": "nor", "not": "not"}
_SIGNS = {"&": "and", "&&": "and", "|": "or", "||": "or"}


def tokens(query: str) -> list[tuple[str, str]]:
    """Tokens as (kind, text); kinds are term, phrase, op, minus, open, close."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(query):
        c = query[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append(("open" if c == "(" else "close", c))
            i += 1
        elif c in "&|":
            n = 2 if query[i : i + 2] in _SIGNS else 1
            out.append(("op", _SIGNS[query[i : i + n]]))
            i += n
        elif c == '"':
            end = query.find('"', i + 1)
            if end < 0:
                raise QueryError("unclosed quote")
            out.append(("phrase", query[i + 1 : end]))
            i = end + 1
        elif c == "-" and i + 1 < len(query) and not query[i + 1].isspace():
            out.append(("minus", "-"))
            i += 1
        else:
            end = i
            while end < len(query) and not query[end].isspace() and query[end] not in '()&|"':
                end += 1
            word = query[i:end]
            out.append(("op", _WORDS[word.lower()]) if word.lower() in _WORDS else ("term", word))
            i = end
    return out


class _Reader:
    def __init__(self, toks: list[tuple[str, str]]) -> None:
        self.toks, self.at = toks, 0

    def peek(self) -> tuple[str, str] | None:
        return self.toks[self.at] if self.at < len(self.toks) else None

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.toks[self.at - 1]

    def any_of(self):
        left = self.all_of()
        while (t := self.peek()) and t[0] == "op" and t[1] in ("or", "nor", "xor"):
            op = self.take()[1]
            right = self.all_of()
            left = Not(Many("or", (left, right))) if op == "nor" else Many(op, (left, right))
        return left

    def all_of(self):
        left = self.unary()
        while t := self.peek():
            if t[0] == "op" and t[1] in ("and", "nand"):
                op = self.take()[1]
                right = self.unary()
                left = Not(Many("and", (left, right))) if op == "nand" else Many("and", (left, right))
            elif t[0] in ("term", "phrase", "minus", "open") or t == ("op", "not"):
                left = Many("and", (left, self.unary()))
            else:
                break
        return left

    def unary(self):
        if (t := self.peek()) is None:
            raise QueryError("an operand is missing at the end")
        if t == ("op", "not") or t[0] == "minus":
            self.take()
            return Not(self.unary())
        if t[0] == "open":
            self.take()
            inner = self.any_of()
            if self.peek() is None or self.take()[0] != "close":
                raise QueryError("a closing parenthesis is missing")
            return inner
        if t[0] in ("term", "phrase"):
            return Term(self.take()[1])
        raise QueryError(f"an operand is missing before {t[1]!r}")


def parse(query: str):
    """AST of a query; QueryError if it is empty or malformed."""
    toks = tokens(query)
    if not toks:
        raise QueryError("empty query")
    r = _Reader(toks)
    tree = r.any_of()
    if r.peek() is not None:
        raise QueryError(f"{r.peek()[1]!r} is out of place")
    tree = simplify(tree)
    if tree is None:
        raise QueryError("empty query")
    return tree


def simplify(node):
    """Nested operators of one kind flattened, empty terms dropped; None if nothing is left."""
    if isinstance(node, Term):
        return node if node.text else None
    if isinstance(node, Not):
        inner = simplify(node.of)
        return None if inner is None else inner.of if isinstance(inner, Not) else Not(inner)
    parts: list = []
    for x in node.of:
        x = simplify(x)
        if isinstance(x, Many) and x.kind == node.kind:
            parts.extend(x.of)
        elif x is not None:
            parts.append(x)
    return None if not parts else parts[0] if len(parts) == 1 else Many(node.kind, tuple(parts))


def holds(node, line: str, sensitive: bool = False) -> bool:
    """Evaluate an AST on one string: the differential oracle of the compiled form."""
    if isinstance(node, Term):
        return node.text in line if sensitive else node.text.lower() in line.lower()
    if isinstance(node, Not):
        return not holds(node.of, line, sensitive)
    values = [holds(x, line, sensitive) for x in node.of]
    return all(values) if node.kind == "and" else any(values) if node.kind == "or" else sum(values) % 2 == 1


def required(node) -> list[str]:
    """Terms which every matching line contains."""
    if isinstance(node, Term):
        return [node.text]
    if isinstance(node, Many) and node.kind == "and":
        return [t for x in node.of for t in required(x)]
    return []


def positive(node) -> list[str]:
    """Terms that can place a hit: those not below a negation."""
    if isinstance(node, Term):
        return [node.text]
    return [t for x in node.of for t in positive(x)] if isinstance(node, Many) else []


def is_boolean(query: str) -> bool:
    """Whether a query needs more than a plain literal search (operators, phrases, exclusions or several words)."""
    try:
        toks = tokens(query)
    except QueryError:
        return False
    return len(toks) > 1 or any(t[0] != "term" for t in toks)


def _matches(node, text: Column, sensitive: bool) -> Column:
    if isinstance(node, Term):
        return text.contains(node.text if sensitive else node.text.lower())
    if isinstance(node, Not):
        return ~_matches(node.of, text, sensitive)
    parts = [_matches(x, text, sensitive) for x in node.of]
    out = parts[0] if node.kind != "xor" else parts[0].cast("int")
    for p in parts[1:]:
        out = out & p if node.kind == "and" else out | p if node.kind == "or" else out + p.cast("int")
    return out % 2 == 1 if node.kind == "xor" else out


def condition(query, text: Column, sensitive: bool = False) -> Column:
    """The query as a condition on ``text``. The longest required term comes first, as a cheap prefilter: written order is kept."""
    tree = parse(query) if isinstance(query, str) else query
    t = present(text) if sensitive else F.lower(present(text))
    body = _matches(tree, t, sensitive)
    must = sorted(required(tree), key=len, reverse=True)
    return t.contains(must[0] if sensitive else must[0].lower()) & body if must and not isinstance(tree, Term) else body


def first_position(query, text: Column, sensitive: bool = False) -> Column:
    """1-based character position of the leftmost positive term, or null."""
    tree = parse(query) if isinstance(query, str) else query
    t = present(text) if sensitive else F.lower(present(text))
    found = [F.nullif(F.instr(t, w if sensitive else w.lower()), F.lit(0)) for w in positive(tree)]
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("int")


def to_filter(query: str) -> str:
    """The same query as a token filter, if there is one: a conjunction of terms and negated terms."""

    def flat(node, negated: bool) -> list[str]:
        if isinstance(node, Term):
            if any(c.isspace() for c in node.text) or node.text.startswith("-") or 0 < node.text.find("=") < len(node.text) - 1:
                raise QueryError(f"{node.text!r} is no filter token")
            return [("-" if negated else "") + node.text]
        if isinstance(node, Not):
            return flat(node.of, not negated)
        if node.kind == ("or" if negated else "and"):
            return [t for x in node.of for t in flat(x, negated)]
        raise QueryError(f"{node.kind.upper()} has no filter form")

    return " ".join(flat(parse(query), False))


def spans(query: str) -> list[tuple[int, int, str]]:
    """Start, end and text of the terms and phrases as they stand in the query."""
    out, at = [], 0
    for kind, text in tokens(query):
        if kind in ("term", "phrase"):
            at = query.index(text, at)
            out.append((at, at + len(text), text))
            at += len(text)
    return out
