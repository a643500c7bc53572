"""All queries of the subpackage with their SQL."""

from __future__ import annotations

from . import garbled, heavy_hitters, mixture, quality, tokenise

_QUERIES = {
    "p3_found": garbled.p3_found,
    "p3_restored": garbled.p3_restored,
    "p4_found": heavy_hitters.p4_found,
    "p4_top": heavy_hitters.p4_top,
    "p7_ids": tokenise.p7_ids,
    "p8_mix": mixture.p8_mix,
    "p8_shares": mixture.p8_shares,
    "p9_found": quality.p9_found,
    "p9_statistics": quality.p9_statistics,
    "p9_basic": quality.p9_basic,
}


def queries():
    return dict(_QUERIES)


#: white space as Python and the operator see it
_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def oracle_sql():
    return {
        "p9_basic": rf"""
            WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, text, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM d),
            w AS (SELECT doc_id, text, line, regexp_extract_all(line, '[^{_SPACE}]+') AS ws FROM l),
            c AS (SELECT doc_id, text, count(*) FILTER (len(ws) > 0) AS n, sum(len(ws)) AS nw, sum(list_sum(list_transform(ws, lambda x: length(x)))) AS nc, count(*) FILTER (len(ws) > 0 AND right(ws[-1], 1) IN ('.', '!', '?', '…', '。', '！', '？')) AS ended,
              count(*) FILTER (len(ws) > 0 AND regexp_matches(line, '^[{_SPACE}]*(?:[-*+•·]|\(?[0-9]{{1,4}}[.):]|[a-z]\))[{_SPACE}]+')) AS listed FROM w GROUP BY doc_id, text)
            SELECT doc_id, n AS n_lines, cast(nw AS BIGINT) AS n_words, CASE WHEN nw > 0 THEN round(nc / nw, 6) END AS mean_word_length, CASE WHEN n > 0 THEN round(ended / n, 6) END AS line_end_ratio, CASE WHEN n > 0 THEN round(listed / n, 6) END AS list_ratio FROM c""",
        "p4_top": """SELECT label, cast(sum(greatest("count", 0)) AS BIGINT) AS "count", true AS proven FROM top_item WHERE label IS NOT NULL AND label <> '' GROUP BY label ORDER BY 2 DESC, 1 LIMIT 100""",
        "p4_found": """
            SELECT label FROM (SELECT label, sum("count") AS n FROM top_item WHERE label IS NOT NULL AND label <> '' GROUP BY label)
            WHERE n >= 0.005 * (SELECT sum("count") FROM top_item WHERE label IS NOT NULL AND label <> '')""",
    }
