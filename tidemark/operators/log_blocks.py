"""Entries out of classified lines (problem 1), block by block.

A block's plain lines are handled by array operations; only the pieces of JSON objects over several lines pass a scanner.
What depends on the lines before a block is summarised: the pieces at its start by the nesting depths they close (as many
items as the deepest nesting, not as lines), and the last line that is not blank before its first head.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

TIME_KEYS = ["time", "ts", "timestamp", "@timestamp", "datetime", "date", "asctime", "eventTime"]
LEVEL_KEYS = ["level", "lvl", "severity", "sev", "levelname", "log_level", "loglevel", "priority"]
COMPONENT_KEYS = ["component", "logger", "module", "source", "comp", "logger_name", "unit", "subsystem", "category", "name"]
MESSAGE_KEYS = ["msg", "message", "text"]
SESSION_KEYS = ["session", "sid", "session_id", "sessionId"]

_FIELD = {k: f for f, ks in (("ts_raw", TIME_KEYS), ("lvl", LEVEL_KEYS), ("comp", COMPONENT_KEYS), ("msg", MESSAGE_KEYS), ("session", SESSION_KEYS)) for k in ks}
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([{\[])|([}\]])|(:)|([^\s{}\[\]:,"]+)')
_ROW = "first_line long, last_line long, lvl string, comp string, ts_raw string, msg string"
#: kind 0: a finished entry; 1: the summary of a block's start; 2: an entry among the pieces there; 3: of its rest
_OUT = f"file string, blk long, kind int, {_ROW}, before long, more string"
_FIELDS = ["lvl", "comp", "ts_raw", "msg"]
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in _OUT.split(", ")]


def _events(text: str) -> Iterator[tuple]:
    """``+1``/``-1`` for brackets and (field, value) for the known keys with a scalar value in a piece of JSON."""
    key, waiting = None, False
    for m in _TOKEN.finditer(text):
        k = m.lastindex
        if k == 1 or k == 5:
            if waiting and key in _FIELD:
                v = m[k]
                if k == 1 and "\\" in v:
                    try:
                        v = json.loads(f'"{v}"', strict=False)
                    except ValueError:
                        pass
                yield _FIELD[key], v
            key, waiting = (m[1] if k == 1 and not waiting else None), False
        elif k == 4:
            waiting = key is not None
        else:
            key, waiting = None, False
            yield 1 if k == 2 else -1, None


class Scan:
    """A JSON object over several lines: its depth and what its outermost level states."""

    def __init__(self, first: int, at: int = -1):
        self.first, self.at, self.depth, self.done, self.fields = first, at, 0, False, {}

    def feed(self, text: str) -> bool:
        """Read one line; true if the object has just come to state all that an entry needs."""
        for e, v in _events(text):
            if isinstance(e, int):
                self.depth += e
                if self.depth <= 0:
                    break
            elif self.depth == 1:
                self.fields.setdefault(e, v)
        return self.complete()

    def complete(self) -> bool:
        f = self.fields
        if self.done or not ("ts_raw" in f and "comp" in f and ("lvl" in f or "session" in f)):
            return False
        self.done = True
        return True

    def row(self) -> list:
        return [self.fields.get("lvl"), self.fields["comp"], self.fields["ts_raw"], self.fields.get("msg", "")]


class Lead:
    """The pieces at a block's start, for every depth at which an object may be open there: what it states at its outermost
    level and the line that closes it. Depth is counted from the block's start, so an object of depth d closes at -d."""

    def __init__(self) -> None:
        self.depth, self.levels, self.pieces = 0, {}, 0

    def feed(self, line: int, text: str) -> None:
        self.pieces += 1
        for e, v in _events(text):
            if isinstance(e, int):
                self.depth += e
                if e < 0 and self.depth < 0 and (lv := self.levels.setdefault(self.depth + 1, {"close": None, "fields": {}}))["close"] is None:
                    lv["close"] = line
            elif self.depth <= 0 and (lv := self.levels.setdefault(self.depth, {"close": None, "fields": {}}))["close"] is None:
                lv["fields"].setdefault(e, v)


def _block(file: str, blk: int, line: np.ndarray, t: np.ndarray, col: dict[str, pa.Array]) -> pa.RecordBatch:
    """Output rows of one block's lines, sorted by number and without repeats."""
    blank = t == "B"
    upto = np.maximum.accumulate(np.where(blank, -1, line))  # the last line so far that is not blank
    is_head, is_piece = t == "H", t == "P"
    places, scans = np.flatnonzero(is_head), {}
    lead, lead_end, tail = Lead(), len(line), None
    stops = np.flatnonzero(is_head | (t == "X"))
    if len(stops):
        lead_end = int(stops[0])
    if is_piece.any():
        at = np.flatnonzero(is_piece)
        since = np.searchsorted(stops, at)
        scan, before = None, -1
        for i, n, text in zip(at.tolist(), since.tolist(), col["piece"].take(pa.array(at)).to_pylist()):
            if n != before:
                scan, before = None, n
            no = int(line[i])
            opens = text.lstrip()[:1] == "{"
            if opens and text[0] == "{" and i < lead_end:
                lead_end = i
            if i < lead_end:
                lead.feed(no, text)
            if opens and (scan is None or text[0] == "{"):
                scan = Scan(no, i)
            if scan is not None:
                if scan.feed(text):
                    scans[scan.at] = scan
                if scan.depth <= 0:
                    scan = None
        tail = scan if before == len(stops) else None
        places = np.union1d(places, np.fromiter(scans, dtype=np.int64, count=len(scans)))
    n = len(places)
    inner = int(np.searchsorted(places, lead_end))
    first_body = int(places[inner]) if inner < n else len(line)
    open_object = None
    if tail is not None:
        open_object = {"first": tail.first, "before": int(upto[tail.at - 1]) if tail.at else -1, "depth": tail.depth, "done": tail.done, "fields": tail.fields}
    rest = json.dumps({"headless": int(upto[first_body - 1]) if first_body else -1, "whole": lead_end == len(line), "object": open_object})
    kind = np.zeros(n, dtype=np.int32)
    kind[:inner] = 2
    if inner < n:
        kind[-1] = 3
    fields = [col[c].take(pa.array(places)) for c in _FIELDS]
    if scans:
        fields = [f.to_pylist() for f in fields]
        for k in np.flatnonzero(np.isin(places, list(scans))).tolist():
            for f, v in zip(fields, scans[int(places[k])].row()):
                f[k] = v
        fields = [pa.array(f, pa.string()) for f in fields]
    ends = np.append(places[1:], len(line))[:n]
    earlier = np.where(places > 0, upto[places - 1], -1)
    out = [pa.array([file] * n, pa.string()), pa.array(np.full(n, blk)), pa.array(kind), pa.array(line[places]), pa.array(upto[ends - 1]), *fields, pa.array(earlier, mask=kind != 2), pa.array([rest if k == 3 else None for k in kind.tolist()], pa.string())]
    more = []
    if inner == n:
        more.append((3, rest))
    if lead.pieces:
        more.append((1, json.dumps({"depth": lead.depth, "levels": sorted(lead.levels.items())})))
    done = pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(out, _TYPES)], _NAMES)
    if not more:
        return done
    extra = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(file, blk, k, *[None] * 7, m) for k, m in more]), _TYPES)], _NAMES)
    return pa.concat_batches([done, extra])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by file, block and number -> finished entries and the summary rows of each block. A block is held at most."""
    held: list[pa.RecordBatch] = []
    key = None

    def flush() -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks()
        line = b["line_no"].to_numpy()
        keep = np.concatenate(([True], line[1:] != line[:-1]))
        if not keep.all():
            b, line = b.filter(pa.array(keep)), line[keep]
        t = b["t"].combine_chunks().dictionary_encode() if isinstance(b["t"], pa.ChunkedArray) else b["t"].dictionary_encode()
        kinds = np.array(t.dictionary.to_pylist(), dtype="U1")[t.indices.to_numpy()]
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return _block(*key, line, kinds, {c: whole(b[c]) for c in (*_FIELDS, "piece")})

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blks = batch["file"], batch["blk"].to_numpy()
        names = np.array(files.dictionary_encode().indices)
        edges = [0, *(np.flatnonzero((blks[1:] != blks[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            now = (files[a].as_py(), int(blks[a]))
            if now != key:
                if held:
                    yield flush()
                key, held[:] = now, []
            held.append(batch.slice(a, z - a))
    if held:
        yield flush()
    held.clear()
    pa.default_memory_pool().release_unused()
    yield pa.RecordBatch.from_arrays([pa.array([], k) for k in _TYPES], _NAMES)


class _Stitch:
    """One file's summary rows in order -> the entries that were open at a block's end, and those among leading pieces."""

    def __init__(self, file: str):
        self.file, self.entry, self.last, self.object, self.out = file, None, -1, None, []
        self.cutoff = None  # entries among leading pieces up to this line are inner objects
        self.blk = None

    def close(self, last: int) -> None:
        if self.entry is not None:
            self.entry[1] = max(self.entry[0], last)
            self.out.append([self.file, *self.entry])
        self.entry = None

    def step(self, r: dict) -> None:
        if r["blk"] != self.blk:
            self.blk, self.cutoff, self.led = r["blk"], None, False
        row = [r[c] for c in ("first_line", "last_line", "lvl", "comp", "ts_raw", "msg")]
        if r["kind"] == 1:
            self.led = True
            if self.object is not None:
                self.lead(json.loads(r["more"]))
        elif r["kind"] == 2:
            if self.cutoff is None or row[0] > self.cutoff:
                self.close(max(self.last, r["before"]))
                self.entry, self.last = row, row[1]
        else:
            self.body(json.loads(r["more"]), row)

    def lead(self, more: dict) -> None:
        o = self.object
        level = dict(more["levels"]).get(1 - o["depth"], {"close": None, "fields": {}})
        if not o["done"]:
            s = Scan(o["first"])
            s.fields = level["fields"] | o["fields"]
            o["fields"] = s.fields
            if s.complete():
                o["done"] = True
                self.close(o["before"])
                self.entry = [o["first"], o["first"], *s.row()]
        elif self.entry is not None and self.entry[0] == o["first"]:
            self.entry[5] = self.entry[5] or level["fields"].get("msg", "")
        if level["close"] is not None:
            self.cutoff, self.object = level["close"], None
        else:
            self.cutoff = 1 << 62
            o["depth"] += more["depth"]

    def body(self, more: dict, row: list) -> None:
        earlier = self.last
        self.last = max(self.last, more["headless"])
        if row[0] is not None:
            self.close(self.last)
            self.entry, self.last = row, row[1]
        inner = self.cutoff == 1 << 62 and more["whole"]  # the open object goes on over the whole block
        if not inner and (not more["whole"] or more["object"] or self.led and self.object is None):
            self.object = more["object"]
            if self.object and self.object["before"] < 0:
                self.object["before"] = earlier


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summary rows sorted by file, block, kind and line -> entries."""
    names = ["file", *(c.split()[0] for c in _ROW.split(", "))]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    s: _Stitch | None = None
    out: list[list] = []
    for batch in batches:
        for r in batch.to_pylist():
            if s is None or r["file"] != s.file:
                if s is not None:
                    s.close(s.last)
                    out += s.out
                s = _Stitch(r["file"])
            s.step(r)
        if s is not None:
            out += s.out
            s.out = []
        if len(out) > 20000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
            out = []
    if s is not None:
        s.close(s.last)
        out += s.out
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, types)], names)


def assemble(lines: DataFrame) -> DataFrame:
    """Classified lines (``file, blk, line_no, t, lvl, comp, ts_raw, msg, piece``) -> entries.

    Only the summaries of a file's blocks, and the objects of an indented array that goes over a block's border, pass one
    task per file, as a stream.
    """
    placed = lines.select("file", "blk", "line_no", "t", "lvl", "comp", "ts_raw", "msg", "piece").repartition("file", "blk").sortWithinPartitions("file", "blk", "line_no")
    parts = cut(placed.mapInArrow(_blocks, _OUT))
    done = parts.where("kind = 0").select("file", *[c.split()[0] for c in _ROW.split(", ")])
    rest = parts.where("kind > 0").repartition("file").sortWithinPartitions("file", "blk", "kind", "first_line").mapInArrow(_stitch, f"file string, {_ROW}")
    return done.unionByName(rest).withColumnRenamed("comp", "component")
