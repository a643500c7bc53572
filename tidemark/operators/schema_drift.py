"""Problem 6: one consistent table out of files whose fields drift, and a report of every change.

Rows are path-value maps. Each value is given its raw type; path and type statistics are aggregated by file with
partial aggregation, so the shuffle carries a few numbers per file and field. Changes are read off the statistics of
consecutive files. Parsers are treated alike: their named groups are the fields of a version.

Defined results
* a field belongs to a file if at least MIN_SHARE of its records have it (also with a null or placeholder value);
* its type is the one at least TYPE_SHARE of its non-null, non-placeholder values have, else undefined; an undefined
  type is never reported, and the next defined one is compared with the last defined one;
* the fields that hold time, level and message are those whose values mostly equal the columns of that name; the one
  with the time has no type;
* repeated rows count once; null maps are records without fields; null series, file_seq or names are left out;
* a field that went and one that came are a rename if role or type and the range of values agree; each counts once,
  the best matching pairs first (ties by name).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join, table

MIN_SHARE, TYPE_SHARE = 0.1, 0.9
#: values that stand for a missing one
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "unknown", "??:??:??"]
TYPES = ["integer", "decimal", "boolean", "object", "array", "text"]
ROLES = ["time", "level", "msg"]
_BUCKETS = 16
# The expressions behind the reference's shorthand groups.
TS_GROUP = r"\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?"
LVL_GROUP = r"TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL"
MSG_GROUP, ANY_GROUP = r".*", r"\S+"


def raw_type(value: Column) -> Column:
    """Type of a value written as text; null for null and placeholder values."""
    v = F.trim(value)
    return (
        F.when(value.isNull() | F.lower(v).isin(PLACEHOLDERS), F.lit(None))
        .when(v.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+)([eE][+-]?[0-9]+)?$"), "decimal")
        .when(F.lower(v).isin("true", "false"), "boolean")
        .when(v.startswith("{") & v.endswith("}"), "object")
        .when(v.startswith("[") & v.endswith("]"), "array")
        .otherwise("text")
    )


def _weights(rows: DataFrame) -> DataFrame:
    """Rows with ``w`` = 1/number of copies: keys alone are shuffled to find repeated rows, not whole records."""
    keys = rows.where("file is not null and line is not null").groupBy("file", "line").agg(F.count("*").alias("copies")).where("copies > 1")
    joined = lookup_join(rows, cut(keys), ["file", "line"], "left", salt_by=F.col("line"))
    return joined.withColumn("w", 1.0 / F.coalesce("copies", F.lit(1))).drop("copies")


def field_statistics(rows: DataFrame) -> DataFrame:
    """One row per series, file_seq and field: weights by type and role, and a profile of the values.

    ``rows``: series, file_seq, file, line, time, level, msg, fields.
    """
    slim = rows.where("series is not null and file_seq is not null").select("series", "file_seq", "file", "line", "time", "level", "msg", "fields")
    w = _weights(slim)
    totals = w.groupBy("series", "file_seq").agg(F.sum("w").alias("n_records"))
    cells = w.select("series", "file_seq", "w", "time", "level", "msg", F.explode("fields").alias("field", "value"))
    v = F.col("value")
    cells = cells.select(
        "series",
        "file_seq",
        "field",
        "w",
        raw_type(v).alias("type"),
        F.when(v == F.col("time"), "time").when(v == F.col("level"), "level").when(v == F.col("msg"), "msg").alias("role"),
        F.pmod(F.xxhash64(v), F.lit(_BUCKETS)).cast("int").alias("bucket"),
        F.xxhash64(v).alias("hash"),
        F.length(v).alias("len"),
        F.length(F.regexp_replace(v, "[^0-9]", "")).alias("digits"),
        F.length(F.regexp_replace(v, "[^A-Za-z]", "")).alias("letters"),
        F.length(F.regexp_replace(v, "[^A-Z]", "")).alias("upper"),
        F.expr("try_cast(value as double)").alias("num"),
    )
    t, wt = F.col("type"), F.col("w")
    real = F.when(t.isNotNull(), wt).otherwise(0.0)
    size = F.log10(F.abs("num") + 1)
    aggs = [F.sum(wt).alias("n"), F.sum(real).alias("n_real"), F.approx_count_distinct(F.when(t.isNotNull(), F.col("hash"))).alias("distinct")]
    aggs += [F.sum(F.when(t == x, wt).otherwise(0.0)).alias(f"t_{x}") for x in TYPES]
    aggs += [F.sum(F.when(F.col("role") == r, wt).otherwise(0.0)).alias(f"r_{r}") for r in ROLES]
    aggs += [F.sum(real * F.col(c)).alias(f"s_{c}") for c in ("len", "digits", "letters", "upper")]
    aggs += [F.sum(real * size).alias("s_log"), F.sum(real * size * size).alias("s_log2"), F.min(F.when(t.isNotNull(), F.col("num"))).alias("lo"), F.max(F.when(t.isNotNull(), F.col("num"))).alias("hi")]
    aggs += [F.array(*[F.sum(F.when(F.col("bucket") == b, real).otherwise(0.0)) for b in range(_BUCKETS)]).alias("hist")]
    stats = cells.where("field is not null").groupBy("series", "file_seq", "field").agg(*aggs)
    # one row per file and field on the left, one per file on the right: both small next to the records
    stats = stats.join(totals, ["series", "file_seq"])
    kind = F.coalesce(*[F.when(F.col(f"t_{x}") >= TYPE_SHARE * F.col("n_real"), x) for x in TYPES])
    role = F.coalesce(*[F.when(F.col(f"r_{r}") >= 0.5 * F.col("n"), r) for r in ROLES])
    return stats.where(F.col("n") >= MIN_SHARE * F.col("n_records") - 1e-9).withColumns({"role": role, "kind": F.when(F.col("n_real") > 0, kind)}).withColumn("kind", F.when(F.coalesce(F.col("role") != "time", F.lit(True)), F.col("kind")))


def likeness(a, b) -> float:
    """How well the values of two fields of one file pair agree in kind and range: 0 (not at all) to 1."""
    if (a.role or None) != (b.role or None):
        return 0.0
    if a.role:
        return 2.0
    if not a.kind or a.kind != b.kind or not a.n_real or not b.n_real:
        return 0.0
    if a.kind in ("boolean", "object", "array"):
        la, lb = a.s_len / a.n_real, b.s_len / b.n_real
        return 1.0 - abs(la - lb) / max(la, lb, 1.0)
    few = [x.distinct <= 12 or x.distinct <= 0.15 * x.n_real for x in (a, b)]
    dot = sum(p * q for p, q in zip(a.hist, b.hist))
    cos = dot / math.sqrt((sum(p * p for p in a.hist) * sum(q * q for q in b.hist)) or 1.0)
    if a.kind in ("integer", "decimal"):
        la, lb = a.s_log / a.n_real, b.s_log / b.n_real
        doubt = 2.0 * math.sqrt(sum(max(x.s_log2 / x.n_real - (x.s_log / x.n_real) ** 2, 0.0) / x.n_real for x in (a, b)))
        close = max(0.0, 1.0 - max(0.0, abs(la - lb) - doubt) / 0.6)
        if all(few) and max(a.distinct, b.distinct) <= 12:
            return close * cos
        return close
    la, lb = a.s_len / a.n_real, b.s_len / b.n_real
    shape = 1.0 - abs(la - lb) / max(la, lb, 1.0)
    for c in ("s_digits", "s_letters", "s_upper"):
        pa, pb = getattr(a, c) / max(a.s_len, 1.0), getattr(b, c) / max(b.s_len, 1.0)
        shape -= abs(pa - pb)
    if few[0] != few[1] and abs(math.log((a.distinct + 1) / (b.distinct + 1))) > 1.2:
        return 0.0
    return max(0.0, shape) * (cos if max(a.distinct, b.distinct) <= 12 else 1.0)


#: least likeness of a rename
ALIKE = 0.55


def _renames(pdf: pd.DataFrame) -> pd.DataFrame:
    went = list(pdf[pdf["gone"]].sort_values("field").itertuples())
    came = list(pdf[~pdf["gone"]].sort_values("field").itertuples())
    scored = sorted(((-likeness(a, b), a.field, b.field) for a in went for b in came))
    old: dict[str, str] = {}
    new: set[str] = set()
    for score, a, b in scored:
        if -score >= ALIKE and a not in old and b not in new:
            old[a] = b
            new.add(b)
    out = [(r.series, r.seq, r.field, "renamed" if r.field in old else "removed", old.get(r.field)) for r in went]
    out += [(r.series, r.seq, r.field, "added", None) for r in came if r.field not in new]
    return pd.DataFrame(out, columns=["series", "seq", "field", "change", "new_name"])


def file_changes(rows: DataFrame) -> DataFrame:
    """``series, seq, field, change`` between consecutive files of every series."""
    stats, files = cut(field_statistics(rows)), _files(rows)
    return moves(stats, files).drop("new_name").unionByName(_retyped(stats, files))


def _files(rows: DataFrame) -> DataFrame:
    return rows.where("series is not null and file_seq is not null").select("series", "file_seq").distinct()


def _followed(files: DataFrame) -> DataFrame:
    by_series = Window.partitionBy("series").orderBy("file_seq")  # one small row per file
    return files.withColumn("next_seq", F.lead("file_seq").over(by_series)).withColumn("prev_seq", F.lag("file_seq").over(by_series))


def moves(stats: DataFrame, files: DataFrame) -> DataFrame:
    """``series, seq, field, change, new_name``: fields that came, went or were renamed (only then with ``new_name``)."""
    s = stats.join(_followed(files), ["series", "file_seq"])
    here = s.where("prev_seq is not null").withColumn("seq", F.col("file_seq"))
    before = s.where("next_seq is not null").withColumn("seq", F.col("next_seq"))
    keys = ["series", "seq", "field"]
    moved = before.join(here.select(*keys), keys, "left_anti").withColumn("gone", F.lit(True)).unionByName(here.join(before.select(*keys), keys, "left_anti").withColumn("gone", F.lit(False)))
    use = [*keys, "gone", "kind", "role", "n_real", "distinct", "s_len", "s_digits", "s_letters", "s_upper", "s_log", "s_log2", "hist"]
    # small groups, costly each: as many tasks as there are cores, which the size of the rows would not ask for
    spread = moved.select(*use).repartition(2 * moved.sparkSession.sparkContext.defaultParallelism, "series", "seq")
    return spread.groupBy("series", "seq").applyInPandas(_renames, "series string, seq int, field string, change string, new_name string")


def _retyped(stats: DataFrame, files: DataFrame) -> DataFrame:
    s = stats.join(_followed(files), ["series", "file_seq"])
    # the last defined type of the same field in an unbroken run of files
    typed = s.select("series", F.col("file_seq").alias("seq"), "prev_seq", "field", "kind", "role")
    run = Window.partitionBy("series", "field").orderBy("seq")  # one row per file of a series
    typed = typed.withColumn("broken", F.coalesce(F.lag("seq").over(run) != F.col("prev_seq"), F.lit(True)).cast("int")).withColumn("run", F.sum("broken").over(run))
    known = Window.partitionBy("series", "field", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return typed.withColumn("was", F.last("kind", True).over(known)).where("kind <> was").select("series", "seq", "field", F.lit("retyped").alias("change"))


# ---- patterns ----

_NAME = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)(:?)")
_GROUP = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
_SHORT = {"TS": ("ts", TS_GROUP), "LVL": ("level", LVL_GROUP), "MSG": ("msg", MSG_GROUP)}


def _close(text: str, start: int, opening: str, closing: str) -> int:
    """Index of the bracket that closes the one opened before ``start``; escapes and character classes are skipped."""
    depth, i, in_class = 1, start, False
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def groups(pattern: str | None) -> list[tuple[str, str]]:
    """Names and expressions of a pattern's named groups in order of appearance; shorthand counts as what it stands for."""
    out: list[tuple[str, str]] = []
    i, text = 0, pattern or ""
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif (m := _GROUP.match(text, i)) and (end := _close(text, m.end(), "(", ")")) >= 0:
            out.append((m[1], text[m.end() : end]))
            i = m.end()
        elif (m := _NAME.match(text, i)) and (end := _close(text, m.end(), "{", "}")) >= 0:
            if m[2]:
                out.append((m[1], text[m.end() : end]))
            elif end == m.end():
                out.append(_SHORT.get(m[1], (m[1], ANY_GROUP)))
            i = end + 1
        else:
            i += 1
    return out


def pattern_changes(before: list[tuple[str, str]], now: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Changes from one version's groups to the next one's. Groups of the same name are anchors; between the same two
    anchors a group that went and one that came with the same expression, in order, are the same place renamed."""
    old, new = dict(before), dict(now)
    out = [(k, "retyped") for k in old if k in new and old[k] != new[k]]

    def gaps(side: list[tuple[str, str]], other: dict[str, str]) -> dict[str, tuple[str, int]]:
        anchor, k, found = "", 0, {}
        for name, _ in side:
            if name in other:
                anchor, k = name, 0
            elif name not in found:
                found[name] = (anchor, k)
                k += 1
        return found

    went, came = gaps(before, new), gaps(now, old)
    taken: set[str] = set()
    for name, (anchor, _) in went.items():
        same = [c for c, (a, _) in came.items() if a == anchor and c not in taken and new[c] == old[name]]
        if same:
            taken.add(same[0])
            out.append((name, "renamed"))
        else:
            out.append((name, "removed"))
    return out + [(c, "added") for c in came if c not in taken]


def parser_changes(parsers: DataFrame) -> DataFrame:
    """``series, seq, field, change`` between consecutive versions of every parser."""
    rows = parsers.where("name is not null and version is not null").groupBy("name", "version").agg(F.max("pattern").alias("pattern"))
    before = rows.withColumn("before", F.lag("pattern").over(Window.partitionBy("name").orderBy("version"))).withColumn("first", F.row_number().over(Window.partitionBy("name").orderBy("version")) == 1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.name, r.version, f, c) for r in pdf.itertuples(index=False) for f, c in pattern_changes(groups(r.before), groups(r.pattern))]
            yield pd.DataFrame(out, columns=["series", "seq", "field", "change"])

    return before.where("not first").select("name", "version", "before", "pattern").mapInPandas(compare, "series string, seq int, field string, change string")


# ---- the consistent table ----

CASTS = {"integer": "bigint", "decimal": "double", "boolean": "boolean"}


_PLACED = "series string, file_seq int, field string, canonical string"


def _place(pdf: pd.DataFrame) -> pd.DataFrame:
    """The canonical name of every field of every file of one series: the first name in its chain of renames."""
    renamed = {(r.file_seq, r.new_name): r.field for r in pdf[pdf["new_name"].notna()].itertuples()}
    fields: dict[int, list[str]] = {}
    for r in pdf[pdf["new_name"].isna()].sort_values(["file_seq", "field"]).itertuples():
        fields.setdefault(r.file_seq, []).append(r.field)
    known: dict[str, str] = {}  # each name's canonical one when last seen
    before: dict[str, str] = {}
    by_file, ever = [], set()
    for seq, names in fields.items():
        now = {f: before[f] for f in names if f in before}
        now |= {f: before[renamed[seq, f]] for f in names if renamed.get((seq, f)) in before}
        for f in names:
            if f not in now:
                c, k = known.get(f, f), 1
                while c in now.values() or (c in ever and f not in known):
                    k += 1
                    c = f"{f}_{k}"
                now[f] = c
        known |= now
        ever |= set(now.values())
        by_file.append((seq, now))
        before = now
    out = []
    for seq, now in by_file:
        # names that are rare in this file but are fields of others, unless the field has another name here
        held = set(now.values())
        for f in sorted(known):
            c = now.get(f, known[f])
            if f in now or c not in held:
                held.add(c)
                out.append((pdf["series"].iloc[0], seq, f, c))
    return pd.DataFrame(out, columns=["series", "file_seq", "field", "canonical"])


def field_ids(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """``series, file_seq, field, canonical``: the one name of each field of a file through the renames of its series."""
    renames = changes.where("change = 'renamed'").select("series", F.col("seq").alias("file_seq"), "field", "new_name")
    rows = stats.select("series", "file_seq", "field", F.lit(None).cast("string").alias("new_name")).unionByName(renames)
    return rows.groupBy("series").applyInPandas(_place, _PLACED)  # as many rows as a series' files have fields


def _kinds(stats: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The type most of a canonical field's values have; integer and decimal count together, and as decimal if a tenth is decimal."""
    sums = stats.join(ids, ["series", "file_seq", "field"]).groupBy(*keys).agg(*[F.sum(f"t_{t}").alias(t) for t in TYPES])
    number = F.col("integer") + F.col("decimal")
    best = F.greatest(number, *[F.col(t) for t in TYPES[2:]])
    numeric = F.when(F.col("decimal") > (1 - TYPE_SHARE) * number, "decimal").otherwise("integer")
    kind = F.when(best <= 0, "text").when(number == best, numeric)
    for t in TYPES[2:]:
        kind = kind.when(F.col(t) == best, t)
    return sums.select(*keys, kind.alias("kind"))


def _once(rows: DataFrame) -> DataFrame:
    """Repeated rows once; rows without a whole key stay as they are."""
    whole = F.col("file").isNotNull() & F.col("line").isNotNull()
    return rows.where(whole).dropDuplicates(["file", "line"]).unionByName(rows.where(~whole))


def _canonical(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with ``cells`` (canonical name -> text) and ``other`` (fields that belong to no file), the statistics and the names."""
    stats = cut(field_statistics(rows))
    ids = cut(field_ids(stats, moves(stats, _files(rows))))
    names = ids.groupBy("series", "file_seq").agg(F.map_from_entries(F.collect_list(F.struct("field", "canonical"))).alias("names"))  # the fields of a series
    slim = _once(rows.select("series", "file_seq", "file", "line", "time", "level", "msg", "fields"))
    named = lookup_join(slim, cut(names), ["series", "file_seq"], "left", salt_by=F.col("line"))
    names_of = F.coalesce("names", F.create_map().cast("map<string,string>"))
    named = named.withColumn("names", names_of)
    cells = F.expr("transform_keys(map_filter(fields, (k, v) -> map_contains_key(names, k)), (k, v) -> names[k])")
    other = F.expr("map_filter(fields, (k, v) -> not map_contains_key(names, k))")
    return named.select("series", "file_seq", "file", "line", "time", "level", "msg", cells.alias("cells"), other.alias("other")), stats, ids


def _cast(kind: str, value: Column) -> Column:
    return F.trim(value).try_cast(CASTS[kind]) if kind in CASTS else value


def unified(rows: DataFrame) -> DataFrame:
    """Long form of the consistent table: one row per record and field under its canonical name, with the value cast to
    the field's main type in its series; a record without fields is one row without ``field``.

    ``series, file_seq, file, line, time, level, msg, field, kind, as_long, as_double, as_boolean, as_text, failed``:
    ``failed`` marks a non-null, non-placeholder value which does not cast; it stays readable in ``as_text``.
    """
    records, stats, ids = _canonical(rows)
    kinds = cut(_kinds(stats, ids, ["series", "canonical"]).withColumnRenamed("canonical", "field"))
    keys = ["series", "file_seq", "file", "line", "time", "level", "msg"]
    pairs = F.concat(F.map_entries(F.coalesce("cells", F.create_map().cast("map<string,string>"))), F.map_entries(F.coalesce("other", F.create_map().cast("map<string,string>"))))
    cells = records.select(*keys, F.explode_outer(pairs).alias("cell")).select(*keys, F.col("cell.key").alias("field"), F.col("cell.value").alias("value"))
    typed = lookup_join(cells, kinds, ["series", "field"], "left", salt_by=F.col("line"))
    as_long = F.when(F.col("kind") == "integer", _cast("integer", F.col("value")))
    as_double = F.when(F.col("kind").isin("integer", "decimal"), _cast("decimal", F.col("value")))
    as_bool = F.when(F.col("kind") == "boolean", _cast("boolean", F.col("value")))
    failed = F.when(F.col("kind") == "integer", as_long.isNull()).when(F.col("kind") == "decimal", as_double.isNull()).when(F.col("kind") == "boolean", as_bool.isNull()).otherwise(False)
    real = raw_type(F.col("value")).isNotNull()
    return typed.select(*keys, "field", F.when(F.col("field").isNotNull(), F.coalesce("kind", F.lit("text"))).alias("kind"), as_long.alias("as_long"), as_double.alias("as_double"), as_bool.alias("as_boolean"), F.col("value").alias("as_text"), (real & failed).alias("failed"))


def consistent(rows: DataFrame) -> DataFrame:
    """The consistent table: every record once, with one typed column a field whatever its name in the record's file.

    ``series, file_seq, file, line, time, level, msg, values, failed, other``: ``values`` is a struct of the canonical
    fields, a field's type being that of most of its values over all series; ``failed`` maps fields to non-placeholder
    values that do not cast, as text, ``other`` holds what is a field of no file. Placeholders in typed columns are null.
    Records without fields, or of no series or file number, are kept. Names that differ in case only get a number.
    """
    records, stats, ids = _canonical(rows)
    # as many rows as there are field names in the schemas
    kinds = {r["canonical"]: r["kind"] for r in _kinds(stats, ids, ["canonical"]).orderBy("canonical").collect()}
    taken: set[str] = set()
    columns = []
    for c, kind in kinds.items():
        name, k = c, 1
        while name.lower() in taken:
            k += 1
            name = f"{c}_{k}"
        taken.add(name.lower())
        columns.append(_cast(kind, F.element_at("cells", F.lit(c))).alias(name))
    bad = lambda k, v: F.lit(False)
    for kind in CASTS:
        of_kind = [c for c, x in kinds.items() if x == kind]
        if of_kind:
            bad = lambda k, v, was=bad, kind=kind, of_kind=of_kind: was(k, v) | (k.isin(of_kind) & _cast(kind, v).isNull() & raw_type(v).isNotNull())
    failed = F.map_filter("cells", lambda k, v: bad(k, v))
    values = F.struct(*columns) if columns else F.lit(None).cast("struct<none:string>")
    return records.select("series", "file_seq", "file", "line", "time", "level", "msg", values.alias("values"), failed.alias("failed"), "other")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``origin, series, seq, field, change``: every change of fields between files and of groups between versions."""
    cols = ["origin", "series", "seq", "field", "change"]
    a = file_changes(table(spark, sf_dir, "json_summary")).withColumn("origin", F.lit("json_summary"))
    b = parser_changes(table(spark, sf_dir, "log_parser")).withColumn("origin", F.lit("log_parser"))
    return a.select(*cols).unionByName(b.select(*cols))


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of all json_summary records."""
    return consistent(table(spark, sf_dir, "json_summary"))
