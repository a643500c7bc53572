"""Problem 1: semi-structured log lines of many layouts -> entries with time, level, component and message.

1. Template mining (iplom): leaf templates give the layouts; a layout's head runs from the line's start over the slots
   of its time, level and component (``layouts``). All lines are mined, so a layout of few lines has its head as well,
   also where a shorter head fits its lines.
2. All heads are compiled into one prefix tree of patterns that classifies each line once, in the JVM (``classified``).
3. Lines become entries per block of BLOCK lines of a file, by array operations on narrow rows (``log_blocks``); what crosses a block's border is stitched from one summary row per block, so a file of any
   size is spread over many tasks.

Defined results
* null, empty and white-space lines are blank: they belong to an entry but never end it;
* repeated rows count once (the first in an arbitrary order, they are equal); rows may come in any order;
* lines before a file's first entry belong to none; null file or line number: left out;
* entries that state a session instead of a level are entries without a level;
* a JSON object over several lines, also one in an indented array, is an entry if it states time, level (or session) and
  component itself, not in an inner object, each key on one line with its value;
* the message is what the entry's first line says behind its head, or the value of its message key; the further lines are
  those up to ``last_line``;
* a level behind more than three words of a head is one only if different levels stand there; else it is part of a message.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import time_pattern
from ..runtime import cut, lookup_join, table
from . import iplom
from .line_types import LETTER, LEVEL, NEAR, SESSION
from .log_blocks import COMPONENT_KEYS, LEVEL_KEYS, MESSAGE_KEYS, SESSION_KEYS, TIME_KEYS, assemble

#: lines a block
BLOCK = 1 << 16
#: level words -> number on the scale 10 trace ... 60 fatal
RANKS = {
    10: "trace verbose finest finer t v",
    20: "debug dbg fine config d",
    30: "info inf information notice i n",
    40: "warn warning wrn w",
    50: "error err severe e",
    60: "critical crit fatal alert emergency emerg panic c f a",
}
_RANK_OF = {w: r for r, ws in RANKS.items() for w in ws.split()}
_CLOSERS = {"]", ")", ">", ":", "|", "-", "--", "---"}
_SEP = "\u0001"


def layouts(lines: DataFrame) -> list[dict]:
    """The layouts of all lines (``text``, ``host``), mined from their templates.

    What comes to the driver are the heads of templates as sequences of classes up to the second word behind the level, in which
    all words look alike: its size follows the number of layouts and of the ways in which their messages begin, not of lines.
    """
    leaves = iplom.templates(iplom.counted(lines))
    keyed = (F.get("slots", F.lit(1))["token"] == "=") & (F.size("slots") > 3)
    # keyed heads keep their constant words (the keys); in the others every word is a "w"
    token = lambda i: F.get("slots", i)["lo"]
    value = lambda i: F.when(token(i) == '"', token(i + 1)).otherwise(token(i))
    places = F.filter(F.sequence(F.lit(1), F.size("slots") - 2), lambda i: (F.get("slots", i)["token"] == "=") & F.get("slots", i - 1)["token"].rlike(r"^[A-Za-z_@][\w.]*$"))
    keys = F.transform(places, lambda i: F.concat(F.get("slots", i - 1)["token"], F.lit("="), F.when(value(i + 1).startswith(iplom.M), F.substring(value(i + 1), 2, 1)).otherwise("*")))
    at = F.slice("slots", 1, F.size("head"))
    words = F.filter(F.arrays_zip(F.col("head").alias("class"), at.alias("slot")), lambda x: x["class"] == "w")
    stated = F.get(F.filter(F.arrays_zip(F.col("head").alias("class"), at.alias("slot")), lambda x: x["class"] == "L"), F.lit(0))["slot"]
    heads = leaves.select("cnt", F.coalesce(keyed, F.lit(False)).alias("keyed"), F.when(keyed, F.array_distinct(keys)).otherwise(F.col("head")).alias("head"), F.transform(words, lambda x: x["slot"]["named"]).alias("named"), stated["lo"].alias("lo"), stated["hi"].alias("hi"))
    each = heads.select("keyed", "head", "cnt", "lo", "hi", F.posexplode_outer("named").alias("k", "share"))
    by_word = each.groupBy("keyed", "head", "k").agg(F.sum(F.col("share") * F.col("cnt")).alias("r"), F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    done = by_word.groupBy("keyed", "head").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("rs"), F.max("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _specs([r.asDict() for r in done.collect()])


def _specs(rows: list[dict]) -> list[dict]:
    out: dict[str, dict] = {}
    plain = [r for r in rows if not r["keyed"]]
    for r in rows:
        if r["keyed"]:
            kinds = [k.rsplit("=", 1) for k in r["head"]]
            t = next((k for k, c in kinds if c == "T"), None)
            lvl = next((k for k, c in kinds if c == "L" and k.lower() in LEVEL_KEYS), None) or next((k for k, c in kinds if c == "L"), None)
            c = next((k for k, x in kinds if k.lower() in COMPONENT_KEYS), None)
            if t and lvl and c:
                out.setdefault(f"{t}|{lvl}|{c}", {"keys": (t, lvl, c), "cnt": 0})["cnt"] += r["cnt"]
    share: dict[tuple[str, ...], list[float]] = {}
    for r in plain:
        rs = {x["k"]: x["r"] for x in r["rs"]}
        for k, i in enumerate(i for i, c in enumerate(r["head"]) if c == "w"):
            s = share.setdefault(tuple(r["head"][: i + 1]), [0.0, 0.0])
            s[0] += rs.get(k) or 0.0
            s[1] += r["cnt"]
    levels: dict[tuple[str, ...], set] = {}
    for r in plain:
        if "L" in r["head"]:
            levels.setdefault(tuple(r["head"][: r["head"].index("L") + 1]), set()).update((r["lo"], r["hi"]))
    for r in plain:
        if spec := _head(r["head"], share, levels):
            key = " ".join(map(str, spec["tokens"])) + f"#{spec['component']}"
            out.setdefault(key, spec | {"cnt": 0})["cnt"] += r["cnt"]
    # the longest heads first, so that none hides behind a shorter one; ties by support
    return sorted(out.values(), key=lambda s: (-len(s.get("tokens", ())), -s["cnt"], str(s)))


def _head(head: list[str], share: dict[tuple[str, ...], list[float]], levels: dict[tuple[str, ...], set]) -> dict | None:
    """The head of a positional layout: its tokens and which of them is the component, or None if the line states no level or session near its start."""
    if not head or head[0] in ("{", '"'):
        return None  # objects state their fields by name
    words, at, level, session = [], None, None, None
    for i, c in enumerate(head):
        if c == "T" and at is None:
            at = i
        elif c in ("L", "P") and level is None:
            level = i
        elif c == "S" and level is None and session is None:
            session = i
        elif c == "w":
            words.append(i)
        if at is not None and (level is not None or session is not None):
            break
    if at is None or (level is None and session is None):
        return None
    end = max(x for x in (at, level, session) if x is not None)
    if sum(i < end for i in words) > NEAR and (level != end or len(levels.get(tuple(head[: end + 1]), ())) < 2):
        return None
    if level is None:
        return {"tokens": head[: end + 1], "component": None} if not words else None

    def numbered(i: int) -> bool:
        s = share.get(tuple(head[: i + 1]), [0.0, 1.0])
        return s[0] >= 0.3 * s[1]

    comp = next((i for i in words if i < end and not numbered(i)), None)
    i = end + 1
    while comp is None and i < len(head):
        if head[i] == "w":
            if not numbered(i):
                comp = i
        elif head[i] in ("T", "L"):
            return None
        i += 1
    if comp is None:
        return None
    end = max(end, comp)
    while end + 1 < len(head) and head[end + 1] in _CLOSERS:
        end += 1
    return {"tokens": head[: end + 1], "component": comp}


_WORDY = {"w", "N", "H", "T", "L", "S"}
_ANY_WORD = r"[^\s\[\](){}<>|,;=\"']+"


def _token(tokens: list[str], i: int, component: bool, n: int) -> str:
    """The pattern of a head's token ``i`` with the space before it; its groups are numbered ``n``."""
    c = tokens[i]
    first = i == 0 or i == 1 and tokens[0] == "L" and c == "T"
    out = ""
    if i:
        apart = set(c) == {"-"} or set(tokens[i - 1]) == {"-"}  # dashes are tokens only where white space sets them apart
        out = r"\s+" if apart or c in _WORDY and tokens[i - 1] in _WORDY and not first else r"\s*"
    if component:
        return out + rf"(?<c{n}>[^\s\[\](){{}}<>|:,;=\"'@]++)"
    if c == "T":
        return out + rf"(?<t{n}>{time_pattern(f'x{n}')})"
    if c == "L":
        return out + rf"(?<l{n}>{LEVEL}|{LETTER})" + ("" if i == 0 and tokens[1:2] == ["T"] else r"(?![\w.=-])")
    if c == "P":
        return out + rf"<(?<p{n}>\d{{1,3}})>"
    if c == "S":
        return out + rf"(?<s{n}>{SESSION})"
    if c == "N":
        return out + r"[\w.#/+-]*\d[\w./+-]*"
    return out + (_ANY_WORD if c in ("w", "H") else re.escape(c))


def head_pattern(specs: list[dict]) -> str:
    """One pattern for all positional heads, as a tree of their common beginnings; the longest heads come first."""
    root: dict = {}
    for s in specs:
        node = root
        for i in range(len(s["tokens"])):
            key = (s["tokens"][i], i == s["component"], tuple(s["tokens"][:2]) if i < 2 else ())
            node = node.setdefault(key, {"tokens": s["tokens"], "kids": {}, "cnt": 0, "deep": 0})
            node["cnt"] += s["cnt"]
            node["deep"] = max(node["deep"], len(s["tokens"]))
            node, last = node["kids"], node
        last["end"] = True
    numbers = iter(range(1 << 30))

    def written(kids: dict, i: int, end: bool) -> str:
        order = sorted(kids.items(), key=lambda x: (-x[1]["deep"], -x[1]["cnt"], str(x[0])))
        parts = [_token(n["tokens"], i, key[1], next(numbers)) + written(n["kids"], i + 1, n.get("end", False)) for key, n in order]
        return "" if not parts else parts[0] if len(parts) == 1 and not end else "(?:" + "|".join(parts + [""] * end) + ")"

    return "^" + written(root, 0, False) + r"\s?(?<m>.*)$"


def _any(keys: list[str]) -> str:
    return "(?:" + "|".join(re.escape(k) for k in keys) + ")"


def _coalesced(m: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.element_at(m, k) for k in keys])


def classified(lines: DataFrame, specs: list[dict]) -> DataFrame:
    """Each line with what it is: ``t`` H (states an entry's head), P (may be part of a JSON object over several lines, whose
    text is ``piece``), B (blank), X (other), and the head's time, level, component and message."""
    text = F.expr("trim(TRAILING '\r' FROM text)")
    plain = [s for s in specs if "tokens" in s]
    keyed = [s for s in specs if "keys" in s]
    line = F.col("line_text")
    heads = F.lit(None).cast("array<string>")
    if plain:
        pattern = head_pattern(plain)
        has = {g: re.findall(rf"\(\?<({g}\d+)>", pattern) for g in "tlpsc"}
        put = _SEP + _SEP.join(["".join(f"${{{x}}}" for x in has[g]) for g in "tlpsc"] + ["${m}"])
        heads = F.split(F.regexp_replace(line, "(?s)" + pattern, put), _SEP)
        heads = F.transform(F.array(heads), lambda h: F.when(F.size(h) == 7, h))[0]
    if keyed:
        bare = F.regexp_replace(line, r'="((?:[^"\\]|\\.)*\s(?:[^"\\]|\\.)*)"', "=~")
        tk, lk, ck = (_any(sorted({s["keys"][i] for s in keyed})) for i in range(3))
        get = lambda keys: F.regexp_extract(bare, rf'(?:^|\s){keys}="?([^"\s]+)"?', 1)
        raw = F.regexp_extract(line, rf'(?:^|\s){tk}=(?:"([^"]*)"|(\S+))', 0)
        # a quoted message, or all up to the next key
        msg = F.regexp_extract(line, rf'(?:^|\s){_any(MESSAGE_KEYS)}=("(?:[^"\\]|\\.)*"|(?:(?!\s[A-Za-z_@][\w.]*=).)*)', 1)
        fields = F.array(F.lit(""), F.regexp_replace(F.trim(raw), r'^[^=]*="?|"$', ""), get(lk), F.lit(""), F.lit(""), get(ck), F.regexp_replace(msg, '^"|"$', ""))
        full = F.transform(F.array(fields), lambda f: F.when((f[1] != "") & (f[2] != "") & (f[5] != ""), f))[0]
        heads = F.when(line.rlike(r"^[A-Za-z_@][\w.]*="), F.coalesce(full, heads)).otherwise(heads)
    obj = lambda m: F.struct(_coalesced(m, TIME_KEYS).alias("t"), _coalesced(m, LEVEL_KEYS).alias("l"), _coalesced(m, SESSION_KEYS).alias("s"), _coalesced(m, COMPONENT_KEYS).alias("c"), _coalesced(m, MESSAGE_KEYS).alias("m"))
    stated = lambda o: F.when(o["t"].isNotNull() & o["c"].isNotNull() & (o["l"].isNotNull() | o["s"].isNotNull()), F.array(F.lit(""), o["t"], F.coalesce(o["l"], F.lit("")), F.lit(""), F.when(o["l"].isNull(), o["s"]).otherwise(""), o["c"], F.coalesce(o["m"], F.lit(""))))
    parsed = F.from_json(F.regexp_replace(line, r",\s*$", ""), "map<string,string>")
    from_obj = F.transform(F.transform(F.array(parsed), obj), stated)[0]
    braced = line.startswith("{") & line.rlike(r"\}\s*,?\s*$")
    piece = line.rlike(r'^\s*(?:["{}]|[\[\]][\[\],\s]*$|(?:-?\d[\d.eE+-]*|true|false|null)\s*,?\s*$)')
    h = F.col("h")
    return (
        lines.select("file", "line_no", F.when(F.col("text").rlike(r"\S"), text).otherwise("").alias("line_text"))
        .withColumn("h", F.when(line == "", F.lit(None)).when(braced, from_obj).when(F.substring(line, 1, 1).isin(" ", "\t"), F.lit(None)).otherwise(heads))
        .withColumn("t", F.when(h.isNotNull(), "H").when(line == "", "B").when(piece, "P").otherwise("X"))
        .select(
            "file",
            "line_no",
            "t",
            h[1].alias("ts_raw"),
            F.when(h[2] != "", h[2]).when(h[3] != "", F.concat(F.lit("<"), h[3])).alias("lvl"),
            h[5].alias("comp"),
            h[6].alias("msg"),
            F.when(F.col("t") == "P", line).alias("piece"),
        )
    )


def level_rank(word: str | None) -> int:
    """Number of a stated level on the scale 10 trace ... 60 fatal; 0 for none or an unknown word; ``<n`` is a syslog priority."""
    if not word:
        return 0
    if word[0] == "<":
        return (60, 60, 60, 50, 40, 30, 30, 20)[int(word[1:]) % 8]
    if word.isdigit():
        return int(word)
    return _RANK_OF.get(word.lower(), 0)


def entries(lines: DataFrame, doc: DataFrame, specs: list[dict] | None = None, block: int = BLOCK) -> DataFrame:
    """``file, first_line, last_line, lvl, component, ts_raw, msg`` of every entry of the files of kind log.

    ``lines``: file, host, line_no, text. ``specs``: layouts known already, else they are mined from all the lines.
    """
    rows = _log_lines(lines, doc)
    narrow = classified(rows, layouts(rows) if specs is None else specs)
    return assemble(narrow.withColumn("blk", F.floor(F.col("line_no") / block).cast("long")))


def _log_lines(lines: DataFrame, doc: DataFrame) -> DataFrame:
    logs = doc.where(F.col("kind") == "log").select("file").distinct()
    return lookup_join(lines.select("file", "host", "line_no", "text").where("file is not null and line_no is not null"), logs, ["file"], "left_semi", salt_by=F.col("line_no"))


def ranked(found: DataFrame) -> DataFrame:
    """Entries with ``rank``, the level as a number (0: none)."""
    words = F.lower("lvl")
    by_word = F.create_map(*[x for w, r in _RANK_OF.items() for x in (F.lit(w), F.lit(r))])
    syslog = F.element_at(F.array(*[F.lit(x) for x in (60, 60, 60, 50, 40, 30, 30, 20)]), (F.substring("lvl", 2, 3).cast("int") % 8) + 1)
    rank = F.when(F.col("lvl").startswith("<"), syslog).when(F.col("lvl").rlike("^[0-9]+$"), F.col("lvl").cast("int")).otherwise(F.element_at(by_word, words))
    return found.withColumn("rank", F.coalesce(rank, F.lit(0)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, first_line, last_line, component`` of entries whose level is error or worse."""
    e = entries(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc"))
    return ranked(e).where("rank >= 50").select("file", "first_line", "last_line", "component")


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its stated time, level, component and message."""
    e = entries(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc"))
    return ranked(e).select("file", "first_line", "last_line", "ts_raw", F.col("lvl").alias("level"), "rank", "component", "msg")


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``template, slots, cnt``: the leaf templates of the lines that may be heads, their number of variable or typed slots and of lines."""
    rows = _log_lines(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc"))
    return iplom.written(iplom.templates(iplom.counted(rows)))
