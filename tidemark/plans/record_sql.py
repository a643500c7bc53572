"""SQL for the queries of the record operators, where SQL can say what they compute on whole tables."""

REJECTS = r"""WITH lv AS (SELECT DISTINCT file, line_no, regexp_replace(text, '\r$', '') AS t, text FROM line_view WHERE text IS NOT NULL AND file IN (SELECT file FROM doc WHERE kind = 'csv')),
h AS (SELECT file, min(line_no) AS head_no, arg_min(text, line_no) AS header FROM line_view WHERE file IN (SELECT file FROM doc WHERE kind = 'csv') GROUP BY file),
d AS (SELECT *, list_reduce([',', ';', chr(9), '|'], lambda a, b: CASE WHEN length(hdr) - length(replace(hdr, b, '')) > length(hdr) - length(replace(hdr, a, '')) THEN b ELSE a END) AS d FROM (SELECT file, head_no, regexp_replace(header, '\r$', '') AS hdr FROM h)),
n AS (SELECT *, list_transform(string_split(hdr, d), lambda x: lower(trim(x, ' "'))) AS names FROM d),
r AS (SELECT lv.file, line_no AS line, text, t, names, n.d,
  regexp_full_match(t, '(?:"(?:[^"]|"")*"|[^"' || n.d || ']*)(?:[' || n.d || '](?:"(?:[^"]|"")*"|[^"' || n.d || ']*))*', 's') AS whole FROM lv JOIN n USING (file) WHERE line_no > head_no),
c AS (SELECT *, CASE WHEN whole THEN list_transform(regexp_extract_all(n1.d || t, '[' || n1.d || ']("(?:[^"]|"")*"|[^"' || n1.d || ']*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS cells FROM r AS n1),
v AS (SELECT *, list_filter(list_transform(range(1, len(names) + 1), lambda i: {'f': names[i], 'v': cells[i]}), lambda x: NOT CASE x.f
    WHEN 'ts' THEN regexp_full_match(x.v, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AND try_strptime(x.v, '%Y-%m-%d %H:%M:%S') IS NOT NULL
    WHEN 'level' THEN upper(x.v) IN ('TRACE', 'DEBUG', 'INFO', 'WARN', 'WARNING', 'ERROR', 'FATAL', 'CRITICAL')
    WHEN 'status' THEN regexp_full_match(x.v, '[1-5][0-9]{2}') WHEN 'ms' THEN regexp_full_match(x.v, '[0-9]+(\.[0-9]+)?') ELSE true END) AS bad FROM c WHERE whole AND len(cells) = len(names)),
csv AS (SELECT 'line_view' AS tbl, file, line, 'quoting' AS reason, NULL AS field, text AS value FROM r WHERE NOT whole
  UNION ALL SELECT 'line_view', file, line, 'columns', NULL, text FROM c WHERE whole AND len(cells) <> len(names)
  UNION ALL SELECT 'line_view', file, line, 'value', bad[1].f, bad[1].v FROM v WHERE len(bad) > 0),
p AS (SELECT DISTINCT file, line, kind, fields, list_sort(map_entries(fields)) AS es FROM parsed_record WHERE kind IN ('generic', 'sql')),
q AS (SELECT *, list_filter(es, lambda e: NOT regexp_full_match(e.value, '(?:[^''"]|''[^'']*''|"[^"]*")*', 's')) AS odd, list_sort(map_keys(fields)) = CASE kind WHEN 'generic' THEN ['bytes', 'ms', 'session', 'status'] ELSE ['action', 'query', 'session'] END AS fit,
  list_filter(es, lambda e: NOT coalesce(CASE e.key WHEN 'status' THEN regexp_full_match(e.value, '[1-5][0-9]{2}') WHEN 'ms' THEN regexp_full_match(e.value, '[0-9]+(\.[0-9]+)?') WHEN 'bytes' THEN regexp_full_match(e.value, '[0-9]+')
    WHEN 'action' THEN e.value IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'MERGE', 'COMMIT', 'ROLLBACK', 'CHECKPOINT', 'TRANSACTION', 'EXECUTE', 'CALL', 'CREATE', 'ALTER', 'DROP', 'TRUNCATE', 'BEGIN') ELSE true END, false)) AS bad FROM p),
rec AS (SELECT 'parsed_record' AS tbl, file, line, CASE WHEN len(odd) > 0 THEN 'quoting' WHEN fit IS NOT TRUE THEN 'columns' WHEN len(bad) > 0 THEN 'value' END AS reason, CASE WHEN len(odd) > 0 THEN odd[1].key WHEN fit THEN bad[1].key END AS field,
  CASE WHEN len(odd) > 0 THEN odd[1].value WHEN fit IS NOT TRUE THEN CAST(to_json(fields) AS VARCHAR) ELSE bad[1].value END AS value FROM q)
SELECT tbl, file, line, reason, field, value FROM csv UNION ALL SELECT tbl, file, line, reason, field, value FROM rec WHERE reason IS NOT NULL"""

SQL = {
    "p5_found": f"SELECT DISTINCT tbl, file, line, reason FROM ({REJECTS})",
    "p5_rejects": REJECTS,
}
