"""Lines as sequences of typed tokens, the input of the layout miner.

Typing all lines with a chain of JVM regexes costs about 60 microseconds a line. Here a batch's lines are folded (every
digit becomes 1) and split at white space; a word's typing is remembered, so that a line costs a few dictionary look-ups
(about 3 microseconds). Lines are counted by their typed form in the task, before any shuffle. The memory is bounded: full
tables are emptied, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

M = "\u0002"  # marks a typed token
#: Level words and abbreviations in any case; single letters only as upper-case tokens of their own.
LEVEL_WORDS = "trace verbose finest finer fine config debug dbg information info inf notice warning warn wrn error err severe critical crit fatal alert emergency emerg panic".split()
LEVEL = "(?i:" + "|".join(sorted(LEVEL_WORDS, key=len, reverse=True)) + ")"
LETTER = "[TVDINWECFA]"
SESSION = r"(?i:sess(?:ion)?[-_#:]\w*\d\w*)"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec January February March April June July August September October November December".split()
DAYS = "Mon Tue Wed Thu Fri Sat Sun Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
#: a level behind more words than this is one only if its slot holds different levels (see ``log_entries``)
NEAR = 3
#: words kept behind the level, among them the component
BEHIND = 2
#: entries of the tables of remembered words and counted lines
REMEMBERED = 1 << 16

_FOLD = bytes(0x31 if 0x30 <= b <= 0x39 else b for b in range(256))
_MON = "(?:" + "|".join(MONTHS[:12]) + ")"
_OFFSET = r"(?:Z|[+-]11:?11)?"
_ISO = r"1{4}(?P<q>[-/.])1{1,2}(?P=q)1{1,2}[T_]11(?P<c>:?)11(?P=c)11(?:[.,]1+)?" + _OFFSET
_COMPACT = r"1{8}[T_]1{6}(?:[.,]1+)?" + _OFFSET
_DAY_FIRST = rf"1{{1,2}}[-/]{_MON}[-/]1{{4}}[:T]11:11:11(?:[.,]1+)?" + _OFFSET
_WORD_MASKS = [
    (re.compile(r"^<1{1,3}>"), f" {M}P "),
    (re.compile(rf"(?<![\w.])(?:{_ISO}|{_COMPACT}|{_DAY_FIRST})(?!\w)"), f" {M}T "),
    (re.compile(r"(?<![\w.:])1{1,2}:11:11(?:[.,]1+)?(?:Z|[+-]11:?11)?(?!\w|:\w)"), f" {M}c "),
    (re.compile(rf"(?<![\w./-])(?:1{{4}}(?P<q>[-/.])1{{1,2}}(?P=q)1{{1,2}}|1{{1,2}}(?P<r>[-/.])(?:1{{1,2}}|{_MON})(?P=r)1{{4}})(?![\w/-])"), f" {M}d "),
    (re.compile(r"(?<![\w.])1{10}(?:\.1{1,9}|1{3}|1{6}|1{9})?(?![\w.])"), f" {M}T "),
    (re.compile(r"^[+-]11:?11$"), f"{M}z+ "),
    (re.compile(rf"(?<![\w.\x02-])({LEVEL})(?![\w.=-])"), lambda m: f" {M}L{m[1][0].lower()} "),
    (re.compile(rf"(?:^|(?<=[ |\[(<]))({LETTER})(?=$|[ |\])>])"), lambda m: f" {M}L{m[1].lower()} "),
    (re.compile(rf"\b{SESSION}"), f" {M}S "),
    (re.compile(r"(?<![\w.\x02-])[A-Za-z]+(?:-(?:\d+|[A-Za-z]+))*-\d+(?![\w.-])"), f" {M}R "),
    (re.compile(r"(?<![\w\x02.#/+-])1{1,2}(?![\w./+-])"), f" {M}n "),
    (re.compile(r"(?<![\w\x02.#/+-])1{4}(?![\w./+-])"), f" {M}y "),
    (re.compile(r"(?<![\w\x02.#/+-])[\w.#/+-]*?\d[\w./+-]*"), f" {M}N "),
    (re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*"), "u"),
    (re.compile(r"""([\[\](){}<>|=,;"':@])"""), r" \1 "),
]
_LEVELS = set(LEVEL_WORDS)
_LETTERS = set(LETTER[1:-1])
_NAMED = {m: f"{M}M{m}" for m in MONTHS} | {d: f"{M}W{d}" for d in DAYS}
_BY_LENGTH = {1: f"{M}n", 2: f"{M}n", 4: f"{M}y", 10: f"{M}T", 13: f"{M}T", 16: f"{M}T", 19: f"{M}T"}
#: a time over several words: the day before or after the clock, with or without weekday, year, AM/PM and zone
_TIME = re.compile(rf"(?<!\S)(?:{M}W\w+ (?:, )?)?(?:(?:{M}d|{M}n {M}M\w+ {M}y) {M}c|{M}c {M}d|{M}M\w+ {M}n {M}c(?: {M}y)?|{M}T)(?: [AP]M(?!\S))?(?: {M}z\S+)?(?!\S)")
_GLOG = re.compile(rf"^{M}g\S {M}c(?!\S)")
_BARE = re.compile(rf"^{M}y {M}c(?!\S)")
_UNKNOWN = re.compile(r"(?<!\S)u(?: u)+(?!\S)")
_LEFT = re.compile(rf"{M}(?:([MWz])(\S+)|[gdcny]\S?)")


class _Words(dict):
    """Words (digits folded) -> typed tokens."""

    def __init__(self, zones: frozenset[str]):
        self.zones = zones

    def __missing__(self, w: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        v = self[w] = self.typed(w)
        return v

    def typed(self, w: str) -> str:
        if w.isascii() and w.isalnum():
            if "1" not in w:
                if w.lower() in _LEVELS or w in _LETTERS:
                    return f"{M}L{w[0].lower()}"
                return f"{M}z{w}" if w in self.zones else _NAMED.get(w, w)
            if w.isdigit():
                return _BY_LENGTH.get(len(w), f"{M}N")
            if len(w) == 5 and w[1:] == "1111" and w[0] in _LETTERS:
                return f"{M}g{w[0]}"
            if not (w[0] == M):
                return f"{M}N"
        if w == f"{M}H":
            return w
        for pattern, out in _WORD_MASKS:
            w = pattern.sub(out, w)
        return " ".join(_NAMED.get(x, x) for x in w.split())


def finished(line: str) -> list[str] | None:
    """The typed tokens of a line whose words are typed; null if it states no time, or neither level, priority nor session.

    A level behind more than NEAR words keeps its first letter, so that the miner sees whether its slot varies.
    """
    line = _TIME.sub(f"{M}T", _GLOG.sub(f"{M}L {M}T", _BARE.sub(f"{M}T", line)))
    if f"{M}T" not in line or not (f"{M}L" in line or f"{M}S" in line or f"{M}P" in line):
        return None
    line = _LEFT.sub(lambda m: (m[2] if m[2] != "+" else f"{M}N") if m[1] else f"{M}N", line)
    tokens = _UNKNOWN.sub("u", line).split(" ")
    words, far = 0, False
    for i, t in enumerate(tokens):
        if t[0] == M and t[1] == "L":
            far, keep = True, not far and words > NEAR
            if not keep:
                tokens[i] = f"{M}L"
        elif not far:
            words += token_class(t) == "w"
    return tokens


def token_class(t: str) -> str:
    """``T L P S N H`` for typed tokens, ``w`` for words and numbered names, the sign itself for delimiters and dashes."""
    if t[0] == M:
        return "w" if t[1] == "R" else t[1]
    return t if not any(c == "_" or c.isalnum() for c in t) else "w"


def head(tokens: list[str]) -> list[str]:
    """The classes of the tokens among which a line's head lies: to BEHIND words behind its time and its level or
    session, numbered names such as ``pool-3`` not counted."""
    out, timed, stated, behind = [], False, False, 0
    for t in tokens:
        c = token_class(t)
        if timed and stated:
            behind += c == "w" and t[0] != M
        out.append(c)
        if behind == BEHIND:
            break
        timed |= c == "T"
        stated |= c in ("L", "P", "S")
    return out


def typed_counts(zones: list[str]):
    """A function for ``mapInArrow``: ``text`` -> ``tokens, head, cnt`` of the lines that may be heads of entries."""
    known = frozenset(zones)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(known)
        get = words.__getitem__
        counts: dict[str, int] = {}
        for batch in batches:
            for text in folded(batch.column(0)).to_pylist():
                if text and text[0] != "{":
                    k = " ".join(map(get, text.split()))
                    counts[k] = counts.get(k, 0) + 1
            if len(counts) >= REMEMBERED:
                yield _flushed(counts)
                counts = {}
        yield _flushed(counts)
        pa.default_memory_pool().release_unused()

    return run


def folded(column: pa.Array) -> pa.Array:
    """A column of strings with every digit replaced by 1, in one pass over its buffer."""
    column = column.cast(pa.string())
    valid, offsets, data = column.buffers()
    if data is None:
        return column
    return pa.StringArray.from_buffers(len(column), offsets, pa.py_buffer(data.to_pybytes().translate(_FOLD)), valid, offset=column.offset)


def _flushed(counts: dict[str, int]) -> pa.RecordBatch:
    done: dict[tuple[str, ...], int] = {}
    for k, n in counts.items():
        if (line := finished(k)) is not None and line[0] not in '{"':
            key = tuple(line)
            done[key] = done.get(key, 0) + n
    tokens = [list(k) for k in done]
    return pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array([head(t) for t in tokens], pa.list_(pa.string())), pa.array(list(done.values()), pa.int64())], ["tokens", "head", "cnt"])
