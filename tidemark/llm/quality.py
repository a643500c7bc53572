"""Problem 9: per-document text statistics, and documents of which less than half runs in sentences.

Documents longer than CHUNK characters are split and their chunks spread over all tasks. A chunk's statistics are counts
per line, kept as an associative state: finished lines, and the open line at either end with its open word (boundary
state). States of a document's chunks are merged in order, a fixed number at a time (tree aggregation), so a text of any
length is never read as one. Ratios and rule outcomes are derived from the merged counts.

A line's characters count as running text by rules on its counts: enough words, enough of them function words of some
language (or letters of a script without spaces), few digits and signs, no head of a log line, table, list or dump.
Repeats of the same line beyond the first few are no running text; lines of any length are compared, by a hash of their
characters that can be joined over chunks (a number modulo a prime of 89 bits; white space is left out).

Defined results: null, empty and white-space texts have zero counts and are no case; any line ends (``\\n``, ``\\r\\n``,
``\\r``); texts are whole; statistics do not depend on CHUNK; repeated rows (the same id and text) are one row.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table

CHUNK = 1 << 16
#: chunk states merged at a time
FAN_IN = 256
#: common words of running text, by language
FUNCTION_WORDS = {
    "en": "the a of to and in is it that for was on with as at by be this not are from or but have has had we you i if so when which",
    "de": "der die das und ist nicht ein eine zu mit den auf von im wird war sich es dem auch nach wie wir wenn hat noch bei dass sie was seit zwar bitte erst",
    "fr": "le la les de des et est un une que ne pas pour dans sur au avec il nous plus ce par sont du qui si en d'une",
    "es": "el la los las de y es un una que no en por con del se lo para al como su más cuando nos esta ya",
    "pt": "o os as um uma que não em por com do da se para ao como mais quando foi",
    "it": "il lo gli un che non per con del della si come più di è sono nel",
    "id": "yang dan di itu ini tidak dengan untuk pada dari akan sudah oleh kami ke hanya juga saat karena setelah sebelum satu kali dapat saat lagi bahwa atau seperti",
    "ru": "и в не на что с по как за из от к он мы то это для когда же бы но у был до только после перед чего том тем того также хотя",
    "nl": "het een en van niet dat op met te zijn voor als er maar ook",
    "pl": "nie się jest na że do to z jak po od dla ale przez",
}
_COMMON = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())
_LINE_END = re.compile(r"\r\n|\r|\n")
_STRUCTURE = re.compile(
    r"\s*(?:"
    r"\[?\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}"  # a log line
    r"|[0-9a-f]{6,}\b\s+(?:[0-9a-f]{2,4}\s+){3}"  # a dump
    r"|\|"  # a table
    r"|[<{\[]"  # markup
    r")"
)
#: a key of a setting, if just one word follows it in its line
_KEY = re.compile(r"[\w.-]{1,48}\s{0,4}[=:]")
#: characters that the patterns for the beginning of a line look at, white space before them not counted
_START = 128
_PRIME = 2**89 - 1
_BULLET = re.compile(r"\s*(?:[-*+•·]|\(?\d{1,4}[.):]|[a-z]\))\s+")
_EDGE = ".,;:!?\"'()[]{}«»„“”‘’…¿¡`*_-—–。、！？"
_ENDS = tuple(".!?…。！？")
MIN_WORDS, MIN_COMMON, MIN_PLAIN = 4, 0.1, 0.6
#: a line that occurs more often than this is boilerplate
REPEATS = 3


@dataclass
class Line:
    """Associative counts of (part of) a line. ``head`` and ``tail`` are its open words; a part without white space is all ``head``."""

    chars: int = 0
    words: int = 0
    common: int = 0
    plain: int = 0
    letters: int = 0
    digits: int = 0
    signs: int = 0
    spaces: int = 0
    kana: int = 0
    wide: int = 0
    tabs: int = 0
    word_chars: int = 0
    stops: int = 0
    head: str = ""
    tail: str = ""
    split: bool = False  # whether there is white space between head and tail
    start: str = ""  # the first characters behind leading white space, for the structure rules
    raw: str = ""  # the first characters
    last: str = ""  # the last character that is no white space
    hash: int = 0  # of the bytes that are no white space, as one number modulo _PRIME
    bytes: int = 0  # how many they are

    COUNTS = ("chars", "words", "common", "plain", "letters", "digits", "signs", "spaces", "kana", "wide", "tabs", "word_chars", "stops")


#: word -> (common, plain, stop); emptied when it has grown, so its memory is bounded
_SEEN_WORDS: dict[str, tuple[bool, bool, bool]] = {}
_DIGITS, _LETTERS, _SPACES = b"0123456789", bytes(range(65, 91)) + bytes(range(97, 123)), b" \t\x0b\x0c\r\n\x1c\x1d\x1e\x1f"
_ASCII = re.compile(r"[\x00-\x7f]+")


def _kind(w: str) -> tuple[bool, bool, bool]:
    got = _SEEN_WORDS.get(w)
    if got is None:
        bare = w.strip(_EDGE).lower()
        got = bare in _COMMON, bool(bare) and bare.replace("-", "").replace("'", "").replace("\u2019", "").isalpha(), w[-1] in ".!?\u2026"
        if len(w) <= 64:
            if len(_SEEN_WORDS) > 200_000:
                _SEEN_WORDS.clear()
            _SEEN_WORDS[w] = got
    return got


def _count_words(line: Line, words: list[str]) -> None:
    common = plain = stops = chars = 0
    for w in words:
        c, p, s = _kind(w)
        common, plain, stops, chars = common + c, plain + p, stops + s, chars + len(w)
    line.words += len(words)
    line.common += common
    line.plain += plain
    line.stops += stops
    line.word_chars += chars


def _word(line: Line, w: str) -> None:
    if w:
        _count_words(line, [w])


def _signs(text: str) -> Line:
    """Counts of characters. ASCII is counted by translation; only other characters are looked at one by one."""
    p = Line(chars=len(text), start=text[:_START].lstrip())
    if len(p.start) < _START < len(text):
        p.start = text.lstrip()[:_START]
    stripped = text.rstrip()
    p.last = stripped[-1:]
    b = text.encode("ascii", "ignore")
    n = len(b)
    p.letters = n - len(b.translate(None, _LETTERS))
    p.digits = n - len(b.translate(None, _DIGITS))
    p.spaces = n - len(b.translate(None, _SPACES))
    p.tabs = b.count(b"\t")
    p.signs = n - p.letters - p.digits - p.spaces
    if n < len(text):
        for c in _ASCII.sub("", text):
            if c.isalpha():
                p.letters += 1
                o = ord(c)
                if o >= 0x3040:
                    p.kana += 0x3040 <= o <= 0x30FF
                    p.wide += unicodedata.east_asian_width(c) in "WF"
            elif c.isdigit():
                p.digits += 1
            elif c.isspace():
                p.spaces += 1
            else:
                p.signs += 1
    return p


def part(text: str) -> Line:
    """Counts of a piece of a line; the words that touch its ends stay open."""
    if not text:
        return Line()
    p = _signs(text)
    words = text.split()
    p.raw = text[:_START]
    _hash(p, words)
    if text[0].isspace():
        words.insert(0, "")
    if text[-1].isspace():
        words.append("")
    if len(words) == 1:
        p.head = words[0]
    else:
        p.split, p.head, p.tail = True, words[0], words[-1]
        _count_words(p, words[1:-1])
    return p


def _hash(p: Line, words: list[str]) -> None:
    b = "".join(words).encode("utf-8", "surrogatepass")
    p.bytes, p.hash = len(b), int.from_bytes(b) % _PRIME


def whole_line(text: str) -> tuple[Line, list[str]]:
    """closed(part(text)) in one step, but for the hash, and the line's words."""
    if not text:
        return Line(), []
    p = _signs(text)
    words = text.split()
    _count_words(p, words)
    return p, words


def joined(a: Line, b: Line) -> Line:
    """The line made of two neighbouring parts."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    out = Line(**{c: getattr(a, c) + getattr(b, c) for c in Line.COUNTS})
    out.raw = (a.raw + b.raw)[:_START] if len(a.raw) < _START else a.raw
    out.start = (a.start + b.raw)[:_START] if a.start else b.start
    out.bytes, out.hash = a.bytes + b.bytes, (a.hash * pow(256, b.bytes, _PRIME) + b.hash) % _PRIME
    out.last = b.last or a.last
    if a.split and b.split:
        _word(out, a.tail + b.head)
        out.split, out.head, out.tail = True, a.head, b.tail
    elif a.split:
        out.split, out.head, out.tail = True, a.head, a.tail + b.head
    elif b.split:
        out.split, out.head, out.tail = True, a.head + b.head, b.tail
    else:
        out.head = a.head + b.head
    return out


def closed(p: Line) -> Line:
    """A whole line: its open words are words."""
    out = Line(**{c: getattr(p, c) for c in Line.COUNTS}, start=p.start, last=p.last, hash=p.hash, bytes=p.bytes)
    _word(out, p.head)
    _word(out, p.tail)
    return out


def _setting(p: Line) -> bool:
    """Whether a line is a key, a sign and one word."""
    m = _KEY.match(p.start)
    if m is None:
        return False
    words, apart = len(p.start[: m.end()].split()), p.start[m.end() : m.end() + 1].isspace()
    return p.words == words + apart and p.bytes != len("".join(p.start[: m.end()].split()).encode())


def running(p: Line, listed: bool | None = None) -> bool:
    """Whether a whole line is running text."""
    solid = p.chars - p.spaces
    listed = bool(_BULLET.match(p.start)) if listed is None else listed
    if not solid:
        return False
    if p.kana >= 0.15 * solid and p.letters >= 0.6 * solid or p.wide >= 0.5 * solid and p.signs + p.digits <= 0.3 * solid and p.wide >= 8:
        return True
    if _STRUCTURE.match(p.start) or _setting(p) or p.tabs >= 2 or p.digits > 0.25 * solid or p.signs > 0.25 * solid:
        return False
    need = MIN_WORDS + 3 if listed else MIN_WORDS
    if p.words < need:
        # the end of a wrapped sentence
        return p.last in _ENDS and p.words >= 1 and p.plain == p.words and not listed
    return p.plain >= MIN_PLAIN * p.words and (p.common >= MIN_COMMON * p.words or p.common >= 1 and p.stops >= 1)


@dataclass
class State:
    """Associative statistics of a piece of text: sums over its finished lines and the open lines at its ends."""

    sums: dict[str, int] = field(default_factory=dict)
    seen: dict[str, list[int]] = field(default_factory=dict)  # running lines by hash: [times, characters]
    first: Line = field(default_factory=Line)
    last: Line = field(default_factory=Line)
    broken: bool = False  # whether a line ends within the piece


SUMS = ["lines", "chars", "solid", "words", "word_chars", "common", "plain", "letters", "digits", "signs", "ended", "running", "running_lines", "listed"]


def _finish(s: State, w: Line, words: list[str] | None = None) -> None:
    """Add a whole line (closed); ``words`` if its hash is still to be made."""
    sums = s.sums
    solid = w.chars - w.spaces
    if not solid:
        return
    if words is not None and (w.words <= 3 and ("=" in w.start or ":" in w.start)):
        _hash(w, words)
        words = None
    listed = bool(_BULLET.match(w.start))
    run = running(w, listed)
    for k, v in zip(SUMS, (1, w.chars, solid, w.words, w.word_chars, w.common, w.plain, w.letters, w.digits, w.signs, int(w.last in _ENDS), solid if run else 0, int(run), int(listed))):
        sums[k] = sums.get(k, 0) + v
    if run:
        if words is not None:
            _hash(w, words)
        s.seen.setdefault(f"{w.bytes:x}-{w.hash:x}", [0, solid])[0] += 1


def state(text: str) -> State:
    """State of one piece of text."""
    s = State()
    pieces = _LINE_END.split(text)
    s.first = part(pieces[0])
    if len(pieces) > 1:
        s.broken = True
        for x in pieces[1:-1]:
            _finish(s, *whole_line(x))
        s.last = part(pieces[-1])
    return s


def merged(a: State, b: State) -> State:
    """State of two neighbouring pieces."""
    s = State(sums=dict(a.sums), seen={k: list(v) for k, v in a.seen.items()}, broken=a.broken or b.broken)
    for k, v in b.sums.items():
        s.sums[k] = s.sums.get(k, 0) + v
    for k, v in b.seen.items():
        s.seen.setdefault(k, [0, v[1]])[0] += v[0]
    s.first, s.last = a.first, b.last
    if not a.broken:
        s.first = joined(a.first, b.first)
    elif not b.broken:
        s.last = joined(a.last, b.first)
    else:
        # a line end that a cut halves gives an empty line, which counts nothing
        _finish(s, closed(joined(a.last, b.first)))
    return s


def ended(s: State) -> State:
    """State of a whole document: its open lines are lines."""
    end = State(sums=dict(s.sums), seen={k: list(v) for k, v in s.seen.items()})
    _finish(end, closed(s.first))
    if s.broken:
        _finish(end, closed(s.last))
    return end


def totals(s: State) -> dict[str, int]:
    """Counts of a whole document."""
    end = ended(s)
    out = {k: end.sums.get(k, 0) for k in SUMS}
    # boilerplate: of a repeated line only the first few count as running text
    out["repeated"] = sum((n - REPEATS) * solid for n, solid in end.seen.values() if n > REPEATS)
    out["running"] -= out["repeated"]
    return out


def packed(s: State) -> bytes:
    """A state as bytes."""
    from dataclasses import asdict

    return json.dumps(asdict(s)).encode()


def unpacked(data: bytes) -> State:
    d = json.loads(data)
    return State(**d | {"first": Line(**d["first"]), "last": Line(**d["last"])})


_SCHEMA = ", ".join(f"{k} long" for k in [*SUMS, "repeated"])


_PIECE = "doc {kind}, h long, size int, at int, state binary, line string, times long, solid long"


def _pieces(chunk: int):
    """Long texts -> their chunks, each cut out once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, h, size, t in zip(pdf["doc"], pdf["h"], pdf["size"], pdf["t"]):
                n = -(-len(t) // chunk)
                for a in range(0, n, 64):  # a few chunks at a time, whatever the text's length
                    at = range(a, min(a + 64, n))
                    yield pd.DataFrame({"doc": [doc] * len(at), "h": h, "size": size, "at": list(at), "piece": [t[i * chunk : (i + 1) * chunk] for i in at]})

    return run


def _chunk_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks -> a state each, and one row for each of its distinct running lines, which the states do without."""
    for pdf in batches:
        rows: list[tuple] = []
        for doc, h, size, at, piece in zip(pdf["doc"], pdf["h"], pdf["size"], pdf["at"], pdf["piece"]):
            s = state(piece)
            rows += [(doc, h, size, at, None, k, n, solid) for k, (n, solid) in s.seen.items()]
            s.seen = {}
            rows.append((doc, h, size, at, packed(s), None, None, None))
        yield _piece_frame(rows)


def _piece_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc", "h", "size", "at", "state", "line", "times", "solid"])
    return out.astype({"times": "Int64", "solid": "Int64"})


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """States of neighbouring chunks -> one state; ``seen`` holds the lines that crossed a border, one a border at most."""
    pdf = pdf.sort_values("at")
    s = None
    for x in pdf["state"]:
        nxt = unpacked(x)
        s = nxt if s is None else merged(s, nxt)
    return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "h": [pdf["h"].iloc[0]], "size": [pdf["size"].iloc[0]], "at": [pdf["at"].iloc[0] // FAN_IN], "state": [packed(s)]})


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pd.DataFrame([totals(state(t)) for t in pdf["t"]], columns=[*SUMS, "repeated"])
        for i, c in enumerate(("doc", "h", "size")):
            out.insert(i, c, pdf[c].to_numpy())
        yield out


def _from_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merged states -> sums, with the lines that crossed a border."""
    for pdf in batches:
        rows = []
        for doc, h, size, x in zip(pdf["doc"], pdf["h"], pdf["size"], pdf["state"]):
            s = ended(unpacked(x))
            lines = [{"line": k, "times": n, "solid": solid} for k, (n, solid) in s.seen.items()]
            rows.append((doc, h, size, *(s.sums.get(k, 0) for k in SUMS), lines))
        yield pd.DataFrame(rows, columns=["doc", "h", "size", *SUMS, "crossing"])


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id`` and the merged counts of every document with a non-null text, repeated rows once."""
    src = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).where("t is not null")
    src = src.select("doc", F.xxhash64("t").alias("h"), F.length("t").alias("size"), "t")
    kind = src.schema["doc"].dataType.simpleString()
    small = src.where(F.col("size") <= chunk).mapInPandas(_whole, f"doc {kind}, h long, size int, {_SCHEMA}")
    # the chunks of long texts are spread by their place, then written once as states and lines
    pieces = src.where(F.col("size") > chunk).mapInPandas(_pieces(chunk), f"doc {kind}, h long, size int, at int, piece string").repartition("h", "at")
    read = cut(pieces.mapInPandas(_chunk_states, _PIECE.format(kind=kind)))
    states = read.where("state is not null").select("doc", "h", "size", "at", "state").dropDuplicates(["doc", "h", "size", "at"])
    lines = read.where("line is not null").dropDuplicates(["doc", "h", "size", "at", "line"]).select("doc", "h", "size", "line", "times", "solid")
    most = 2**31 // chunk + 1  # a text has at most 2^31 characters
    while most > 1:
        states = states.groupBy("doc", "h", "size", F.floor(F.col("at") / FAN_IN).alias("__g")).applyInPandas(_merge_group, f"doc {kind}, h long, size int, at int, state binary")
        most = -(-most // FAN_IN)
    sums = states.mapInPandas(_from_states, f"doc {kind}, h long, size int, {', '.join(f'{k} long' for k in SUMS)}, crossing array<struct<line:string,times:long,solid:long>>")
    crossing = sums.select("doc", "h", "size", F.inline("crossing"))
    again = lines.unionByName(crossing).groupBy("doc", "h", "size", "line").agg(F.sum("times").alias("times"), F.first("solid").alias("solid")).where(F.col("times") > REPEATS)
    again = again.groupBy("doc", "h", "size").agg(F.sum((F.col("times") - REPEATS) * F.col("solid")).alias("repeated"))
    big = sums.alias("s").join(again.alias("a"), F.col("s.doc").eqNullSafe(F.col("a.doc")) & (F.col("s.h") == F.col("a.h")) & (F.col("s.size") == F.col("a.size")), "left")
    extra = F.coalesce(F.col("a.repeated"), F.lit(0))
    big = big.select("s.doc", "s.h", "s.size", *[(F.col("s.running") - extra).alias("running") if k == "running" else F.col(f"s.{k}") for k in SUMS], extra.alias("repeated"))
    return small.unionByName(big).dropDuplicates(["doc", "h", "size"]).drop("h", "size").withColumnRenamed("doc", doc_id)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Ratios and rule outcomes: ``doc_id, n_lines, n_words, mean_word_length, symbol_ratio, digit_ratio, line_end_ratio,
    list_ratio, common_ratio, running_share, repeated_share, prose``; ``prose`` is null for texts without a character."""
    c = counts(docs, doc_id, text, chunk)
    per = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return c.select(
        doc_id,
        F.col("lines").alias("n_lines"),
        F.col("words").alias("n_words"),
        per("word_chars", "words").alias("mean_word_length"),
        per("signs", "solid").alias("symbol_ratio"),
        per("digits", "solid").alias("digit_ratio"),
        per("ended", "lines").alias("line_end_ratio"),
        per("listed", "lines").alias("list_ratio"),
        per("common", "words").alias("common_ratio"),
        per("running", "solid").alias("running_share"),
        per("repeated", "solid").alias("repeated_share"),
        F.when(F.col("solid") > 0, F.col("running") * 2 >= F.col("solid")).alias("prose"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` of documents of which less than half runs in sentences."""
    return statistics(table(spark, sf_dir, "documents")).where("not prose").select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document with a text."""
    return statistics(table(spark, sf_dir, "documents"))


def p9_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can count as well: lines, words, their mean length, lines that end in punctuation, list items."""
    return p9_statistics(spark, sf_dir).select("doc_id", "n_lines", "n_words", "mean_word_length", "line_end_ratio", "list_ratio")
