"""The license scan in DuckDB's SQL."""

from __future__ import annotations

from lacuna.llm.license_rules import BASE, RULES, Rule


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def scan_sql(rules: list[Rule] = RULES) -> str:
    values = ",\n  ".join(f"({r.order}, {_text(r.label)}, {r.confidence}::DOUBLE, {_text(r.regex)})" for r in rules)
    first_base = len(rules) - BASE
    words = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return rf"""
    WITH rules("order", label, confidence, regex) AS (VALUES
  {values}),
    lowered AS (SELECT row_number() OVER () AS row, doc_id, trim(regexp_replace(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS words FROM documents),
    spaced AS (SELECT row, doc_id, CASE WHEN words = '' THEN '' ELSE ' ' || words || ' ' END AS s FROM lowered),
    matched AS (SELECT row, "order", label, confidence, string_split_regex(s, regex) AS pieces, regexp_extract_all(s, regex, 0) AS hits
      FROM spaced JOIN rules ON regexp_matches(s, regex)),
    places AS (SELECT row, "order", label, confidence,
        list_sum(list_transform(pieces[:i], lambda x: {words.format('x')})) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: {words.format('x')})), 0) AS start,
        {words.format('hits[i]')} AS length
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM matched)),
    ended AS (SELECT *, start + length AS "end" FROM places),
    outer_ AS (SELECT * FROM ended QUALIFY "end" > coalesce(max("end") OVER (PARTITION BY row ORDER BY start, "end" DESC, "order"
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)),
    detections AS (SELECT * FROM (SELECT *,
        coalesce(lag("end") OVER w > start AND lag("order") OVER w < "order", false) OR
        coalesce(lead(start) OVER w < "end" AND lead("order") OVER w < "order", false) AS beaten
      FROM outer_ WINDOW w AS (PARTITION BY row ORDER BY start)) WHERE NOT beaten),
    base AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ended WHERE "order" >= {first_base} GROUP BY row),
    named AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
      (SELECT row, label FROM detections UNION ALL SELECT row, label FROM ended WHERE "order" >= {first_base}) GROUP BY row),
    scored AS (SELECT row, max(confidence) AS score, count(*) AS n_detections FROM detections GROUP BY row)
    SELECT doc_id, {words.format('s')} AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score, coalesce(n_detections, 0) AS n_detections
    FROM spaced LEFT JOIN base USING (row) LEFT JOIN named USING (row) LEFT JOIN scored USING (row)
    """
