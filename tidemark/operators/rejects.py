"""Problem 5: load delimited rows and parsed records, and set the ones that do not fit apart with the reason.

Csv lines are checked in Arrow batches. The quoting grammar is one linear regex per layout; the rows that keep
to it go through pyarrow's CSV reader as strings, whose invalid-row callback rejects wrong column counts, and the
string columns are then cast as vectors, which labels failing cells. Record maps are checked in the JVM.

Defined results
* reasons, first that applies: ``quoting``, ``columns``, ``value``;
* a null text is no row and is left out; an empty one is a row of one empty cell;
* a null header or a file without lines yields nothing; the header row itself is never reported;
* cells are whole: no length limit; a line feed inside a line's text is part of its cell;
* null maps, missing, extra or null-valued fields: ``columns`` (null value: ``value``); a kind other than generic
  and sql, or a null one, has no layout and is left out;
* repeated rows give one result row; further columns of the input are ignored; a csv column beyond the known ones is
  loaded as text under its name in the map ``other``;
* an unknown delimiter makes a file of one column, whose header has no known name: its rows stand in ``other``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join, table

LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL"]
ACTIONS = "SELECT INSERT UPDATE DELETE MERGE COMMIT ROLLBACK CHECKPOINT TRANSACTION EXECUTE CALL CREATE ALTER DROP TRUNCATE BEGIN".split()
DELIMITERS = [",", ";", "\t", "|"]
_STATUS, _MS = r"^[1-5][0-9]{2}$", r"^[0-9]+(\.[0-9]+)?$"
#: the columns of the typed result, with the check of problem 5 behind each
TYPED = "ts timestamp, level string, session string, status int, ms double, msg string"
_KNOWN = [c.split()[0] for c in TYPED.split(", ")]
#: what only valid record maps have besides; ``bytes`` holds any number of up to 38 digits, beyond which the load fails
RECORD_TYPED = "bytes decimal(38,0), action string, query string"


def layout(header: str) -> tuple[str, tuple[str, ...], str]:
    """Delimiter, column names and the quoting grammar (a linear regex) of a header line."""
    header = header.removesuffix("\r").removeprefix("\ufeff")
    bare = "".join(header.split('"')[::2])
    d = max(DELIMITERS, key=bare.count)
    names = tuple(c.strip().strip('"').lower() for c in header.split(d))
    cell = rf'(?:"(?:[^"]|"")*"|[^"{"" if d != "|" else ""}{d}]*)'
    sep = "\\|" if d == "|" else d
    return d, names, rf"\A{cell}(?:{sep}{cell})*\z"


def _existing_second(values: pa.Array) -> np.ndarray:
    """Which strings are an existing ``YYYY-MM-DD HH:MM:SS``."""
    shaped = pc.match_substring_regex(values, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z")
    safe = pc.if_else(shaped, values, "0000-00-00 00:00:00")
    y, m, d, h, mi, s = (pc.cast(pc.utf8_slice_codeunits(safe, a, b), pa.int32()).to_numpy(False) for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = np.where(m == 2, 28 + leap, np.where(np.isin(m, (4, 6, 9, 11)), 30, 31))
    return (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= days) & (h < 24) & (mi < 60) & (s < 60)


def _good_cells(name: str, values: pa.Array) -> np.ndarray:
    if name == "ts":
        return _existing_second(values)
    if name == "level":
        return pc.is_in(pc.utf8_upper(values), value_set=pa.array(LEVELS)).to_numpy(False)
    if name in ("status", "ms"):
        return pc.match_substring_regex(values, _STATUS if name == "status" else _MS).to_numpy(False)
    return np.ones(len(values), bool)


def read_rows(texts: pa.Array, header: str) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array], np.ndarray]:
    """Reason per row (object array, None if valid), the positions of the structurally whole rows, their cells by column, and
    per row the first column with a failing value."""
    d, names, grammar = layout(header)
    n = len(texts)
    reason, where = np.full(n, None, object), np.full(n, None, object)
    texts = pc.replace_substring_regex(texts, r"\r\z", "")
    whole = pc.match_substring_regex(texts, grammar).to_numpy(False)
    reason[~whole] = "quoting"
    if len(names) > 1:
        # the reader would fill an empty line up with empty cells
        blank = pc.equal(pc.binary_length(texts), 0).to_numpy(False)
        reason[blank] = "columns"
        whole &= ~blank
    at = np.flatnonzero(whole)
    kept = texts.take(pa.array(at))
    # inner line breaks would end a row for the reader: signs that occur nowhere stand for them until the cells are read
    broken = pc.any(pc.match_substring_regex(kept, "[\r\n]")).as_py()
    if broken:
        used = set("".join(kept.to_pylist()))
        feed, ret = [chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in used][:2]
        kept = pc.replace_substring(pc.replace_substring(kept, "\n", feed), "\r", ret)
    wrong: list[int] = []

    def reject(row) -> str:
        wrong.append(row.number)
        return "skip"

    cols = [f"c{i}" for i in range(len(names))]
    cells: dict[str, pa.Array] = {}
    if len(at):
        lines = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
        data = pc.binary_join(lines, "\n")[0].as_buffer().to_pybytes() + b"\n"
        got = pacsv.read_csv(
            pa.BufferReader(data),
            pacsv.ReadOptions(column_names=cols, use_threads=False, block_size=len(data) + 1),
            pacsv.ParseOptions(delimiter=d, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
            pacsv.ConvertOptions(column_types={c: pa.string() for c in cols}, strings_can_be_null=False, check_utf8=False),
        )
        bad = np.array(wrong, np.int64) - 1
        reason[at[bad]] = "columns"
        at = np.delete(at, bad)
        for c, name in zip(cols, names):
            col = got[c].combine_chunks()
            if broken:
                col = pc.replace_substring(pc.replace_substring(col, feed, "\n"), ret, "\r")
            cells.setdefault(name, col)
            good = _good_cells(name, col)
            bad_cells = at[~good]
            reason[bad_cells] = "value"
            where[bad_cells[where[bad_cells] == None]] = name  # noqa: E711
    return reason, at, cells, where


def _batches(batches: Iterator[pa.RecordBatch], typed: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = batch.column("header").dictionary_encode()
        codes = heads.indices.to_numpy(False)
        for code, header in enumerate(heads.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            part = batch.take(pa.array(rows))
            reason, at, cells, where = read_rows(part.column("text"), header)
            ids = [part.column("file"), part.column("line_no")]
            if not typed:
                failing = np.flatnonzero(reason != None)  # noqa: E711
                hit = pa.array(failing)
                place = {int(r): i for i, r in enumerate(at)}
                # the failing cell as it stands, or the whole row if its structure is wrong
                texts = part.column("text").take(hit).to_pylist()
                values = [t if where[r] is None else cells[where[r]][place[int(r)]].as_py() for r, t in zip(failing, texts)]
                yield pa.RecordBatch.from_arrays([c.take(hit) for c in ids] + [pa.array(x, pa.string()) for x in (reason[failing], where[failing], values)], ["file", "line", "reason", "field", "value"])
                continue
            ok = np.array([r is None for r in reason[at]], bool)
            keep, pick = pa.array(at[ok]), pa.array(np.flatnonzero(ok))
            col = {k: v.take(pick) for k, v in cells.items()}
            none = lambda kind: pa.nulls(len(pick), kind)
            stamp = pa.timestamp("us", "UTC")
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(keep) for c in ids),
                    pc.assume_timezone(pc.strptime(col["ts"], "%Y-%m-%d %H:%M:%S", "us"), "UTC") if "ts" in col else none(stamp),
                    pc.utf8_upper(col["level"]) if "level" in col else none(pa.string()),
                    col.get("session", none(pa.string())),
                    pc.cast(col["status"], pa.int32()) if "status" in col else none(pa.int32()),
                    pc.cast(col["ms"], pa.float64()) if "ms" in col else none(pa.float64()),
                    col.get("msg", none(pa.string())),
                    _others({k: v for k, v in col.items() if k not in _KNOWN}, len(pick)),
                ],
                ["file", "line", "ts", "level", "session", "status", "ms", "msg", "other"],
            )


def _others(cols: dict[str, pa.Array], n: int) -> pa.Array:
    """Columns as one map column; null where there are none."""
    kind = pa.map_(pa.string(), pa.string())
    if not cols:
        return pa.nulls(n, kind)
    rows = zip(*(c.to_pylist() for c in cols.values()))
    return pa.array([list(zip(cols, r)) for r in rows], kind)


def csv_lines(lines: DataFrame, doc: DataFrame) -> DataFrame:
    """``file, line_no, text, header`` of the data rows of every csv file: the first line of a file is its header."""
    csv = doc.where(F.col("kind") == "csv").select("file").distinct()
    rows = lookup_join(lines.select("file", "line_no", "text"), csv, ["file"], "left_semi", salt_by=F.col("line_no"))
    heads = cut(rows.where(F.col("line_no").isNotNull()).groupBy("file").agg(F.min(F.struct("line_no", "text")).alias("h")).select("file", F.col("h.line_no").alias("head_no"), F.col("h.text").alias("header")).where("header is not null"))
    joined = lookup_join(rows, heads, ["file"], "inner", salt_by=F.col("line_no"))
    return joined.where("line_no > head_no and text is not null").select("file", "line_no", "text", "header")


def csv_rejects(lines: DataFrame, doc: DataFrame) -> DataFrame:
    """``file, line, reason, field, value`` of every csv row which does not fit its file's layout: the first failing column and
    its cell, or no column and the whole row where the structure is wrong."""
    return csv_lines(lines, doc).mapInArrow(lambda b: _batches(b, False), "file string, line long, reason string, field string, value string").dropDuplicates(["file", "line", "reason"])


def csv_loaded(lines: DataFrame, doc: DataFrame) -> DataFrame:
    """The valid csv rows with typed columns: ``file, line``, TYPED and ``other map``; a column the file lacks is null.
    Repeated rows are found by file, line and a hash of their text."""
    src = csv_lines(lines, doc)
    return src.mapInArrow(lambda b: _batches(b, True), f"file string, line long, {TYPED}, other map<string,string>").dropDuplicates(["file", "line", *_KNOWN])


def record_reason(kind: Column, fields: Column) -> Column:
    """Reason why a record's map does not fit its kind's layout, or null."""
    odd_quote = F.exists(F.map_values(fields), lambda v: ~v.rlike(_CLOSED))
    keys = F.array_sort(F.map_keys(fields))

    def exactly(*names: str) -> Column:
        return keys == F.array(*[F.lit(n) for n in sorted(names)])

    def fits(name: str, pattern: str) -> Column:
        return F.coalesce(F.element_at(fields, name).rlike(pattern), F.lit(False))

    generic = F.when(~exactly("session", "status", "ms", "bytes"), "columns").when(~(fits("status", _STATUS.replace("$", r"\z")) & fits("ms", _MS.replace("$", r"\z")) & fits("bytes", r"^[0-9]+\z")), "value")
    sql = F.when(~exactly("session", "action", "query"), "columns").when(~F.coalesce(F.element_at(fields, "action").isin(ACTIONS), F.lit(False)), "value")
    known = kind.isin("generic", "sql")
    return F.when(known & F.coalesce(odd_quote, F.lit(False)), "quoting").when(known & fields.isNull(), "columns").when(kind == "generic", generic).when(kind == "sql", sql)


def record_rejects(records: DataFrame) -> DataFrame:
    """``file, line, reason, field, value`` of every parsed record whose fields do not fit the layout of its kind: the first
    failing field by name and its value, or the whole map as text where the set of fields is wrong."""
    odd = F.array_sort(F.filter(F.map_entries("fields"), lambda e: ~e["value"].rlike(_CLOSED)))
    bad = F.array_sort(F.filter(F.map_entries("fields"), lambda e: ~F.coalesce(_fits_field(e["key"], e["value"]), F.lit(False))))
    cell = F.when(F.col("reason") == "quoting", F.get(odd, F.lit(0))).when(F.col("reason") == "value", F.get(bad, F.lit(0)))
    whole = F.when(F.col("reason") == "columns", F.to_json("fields"))
    rows = records.select("file", "line", "fields", record_reason(F.col("kind"), F.col("fields")).alias("reason")).where("reason is not null")
    return rows.select("file", "line", "reason", cell["key"].alias("field"), F.coalesce(cell["value"], whole).alias("value")).dropDuplicates(["file", "line", "reason"])


_CLOSED = r"""\A(?:[^'"]|'[^']*+'|"[^"]*+")*+\z"""


def _fits_field(name: Column, value: Column) -> Column:
    """Whether a value fits the field of its name, in the kind which has it."""
    as_is = lambda p: value.rlike(p.replace("$", r"\z"))
    return F.when(name == "status", as_is(_STATUS)).when(name == "ms", as_is(_MS)).when(name == "bytes", value.rlike(r"^[0-9]+\z")).when(name == "action", value.isin(ACTIONS)).otherwise(True)


def records_loaded(records: DataFrame) -> DataFrame:
    """The valid parsed records with the fields of their kind as typed columns: ``file, line, kind, session, status, ms,
    bytes, action, query``; a column the kind lacks is null."""
    field = lambda name: F.element_at("fields", F.lit(name))
    valid = records.where(F.col("kind").isin("generic", "sql") & record_reason(F.col("kind"), F.col("fields")).isNull())
    return valid.select(
        "file", "line", "kind", field("session").alias("session"), field("status").cast("int").alias("status"), field("ms").cast("double").alias("ms"), field("bytes").cast("decimal(38,0)").alias("bytes"), field("action").alias("action"), field("query").alias("query")
    ).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, file, line, reason`` of all failing rows of csv files and of parsed records."""
    a = csv_rejects(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc")).withColumn("tbl", F.lit("line_view"))
    b = record_rejects(table(spark, sf_dir, "parsed_record")).withColumn("tbl", F.lit("parsed_record"))
    return a.unionByName(b).select("tbl", "file", "line", "reason")


def p5_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, file, line, reason, field, value``: the same with the first failing cell, or the whole row without a field."""
    a = csv_rejects(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc")).withColumn("tbl", F.lit("line_view"))
    b = record_rejects(table(spark, sf_dir, "parsed_record")).withColumn("tbl", F.lit("parsed_record"))
    return a.unionByName(b).select("tbl", "file", "line", "reason", "field", "value")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, file, line, kind``, TYPED, RECORD_TYPED and ``other``: the valid rows of all csv files and the valid parsed records,
    typed; ``kind`` is that of a record, columns of the other table are null."""
    rows = csv_loaded(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc")).withColumn("tbl", F.lit("line_view"))
    records = records_loaded(table(spark, sf_dir, "parsed_record")).withColumn("tbl", F.lit("parsed_record"))
    cols = ["tbl", "file", "line", "kind", *(c.split()[0] for c in f"{TYPED}, {RECORD_TYPED}".split(", ")), "other"]
    return rows.unionByName(records, allowMissingColumns=True).select(*cols)
