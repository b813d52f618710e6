"""The SQL that the URL verdicts are checked against."""

from __future__ import annotations

from lacuna.llm import urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


LEVELS = 12
"""Levels that the SQL has; the operator has as many as the labels are mixed in."""


def verdict_sql(rules: list[urls.Rule]) -> str:
    cases = []
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        cases.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in cases) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases) + " END"
    levels = []
    for n in range(1, LEVELS + 1):
        segment = f"s[{n + 1}]"
        if n > urls.DEPTH:
            # Below nodes without mixed labels the rest is one.
            levels.append(f"""
    m{n} AS (SELECT *, sum(bad) OVER w > 0 AND sum(bad) OVER w < sum(labels) OVER w AS mixed FROM t{n - 1} WHERE len(s) > {n}
      WINDOW w AS (PARTITION BY host, template)),
    e{n} AS (SELECT host, path, labels, bad, CASE WHEN mixed THEN template ELSE template || '/**' END AS template,
        CASE WHEN mixed THEN s ELSE s[:{n}] END AS s FROM m{n} UNION ALL SELECT * FROM t{n - 1} WHERE len(s) <= {n})""")
        before = f"e{n}" if n > urls.DEPTH else f"t{n - 1}"
        levels.append(f"""
    h{n} AS (SELECT *, CASE WHEN regexp_matches(g, '{urls.NUMBER}') THEN '{{n}}' WHEN regexp_matches(g, '{urls.HEX}') THEN '{{h}}'
        WHEN regexp_matches(g, '{urls.MIXED}') THEN '{{x}}' ELSE g END AS segment
      FROM (SELECT *, {segment} AS g FROM {before} WHERE len(s) > {n})),
    k{n} AS (SELECT host, template, segment, sum(bad)::DOUBLE AS b, sum(labels)::DOUBLE AS n FROM h{n} GROUP BY ALL),
    c{n} AS (SELECT *, count(*) OVER w AS children, sum(b) OVER w AS ab, sum(n) OVER w AS an FROM k{n}
      WINDOW w AS (PARTITION BY host, template)),
    d{n} AS (SELECT *, (b / n - (ab - b) / (an - n)) * (b / n - (ab - b) / (an - n)) AS apart, ab / an AS p FROM c{n}),
    b{n} AS (SELECT host, template, segment, CASE WHEN children = 1 THEN segment
        WHEN n > 0 AND an - n > 0 AND apart > 0 AND apart >= {urls.DIFFERENT} * (p * (1 - p) * (1 / n + 1 / (an - n))) THEN segment
        WHEN children >= {urls.VARIABLE} THEN '*' ELSE '~' END AS branch FROM d{n}),
    t{n} AS (SELECT h.host, h.path, h.labels, h.bad, h.template || '/' || branch AS template, s
        FROM h{n} h JOIN b{n} USING (host, template, segment)
      UNION ALL SELECT host, path, labels, bad, template, s FROM {before} WHERE len(s) <= {n})""")
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    v AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
    w AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
    r AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM w),
    t0 AS (SELECT host, path, count(rule) AS labels, count(*) FILTER (WHERE ruled = 'block') AS bad, '' AS template,
      string_split(path, '/') AS s FROM r GROUP BY host, path),{",".join(levels)},
    final AS (SELECT * FROM t{LEVELS}),
    hosts AS (SELECT host, (sum(bad) + {urls.SMOOTHING * urls.PRIOR}::DOUBLE) / (sum(labels) + {urls.SMOOTHING}) AS host_share
      FROM final GROUP BY host),
    templates AS (SELECT host, template, (sum(bad) + {urls.SMOOTHING} * any_value(host_share)) / (sum(labels) + {urls.SMOOTHING}) AS bad_share
      FROM final JOIN hosts USING (host) GROUP BY host, template)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bad_share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
      template, bad_share
    FROM r JOIN final USING (host, path) JOIN templates USING (host, template)
    """
