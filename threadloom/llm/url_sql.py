"""DuckDB SQL for the verdicts of ``judge_urls``."""

from __future__ import annotations

from threadloom.llm.url_filters import ALIKE, LEAST_HOSTS, LEAST_PAGES, RULES, STRENGTH


def verdict_sql() -> str:
    """page_id, host, path, rule and verdict of every row of ``pages``: the tree grows by a segment a round."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, verdict) for verdict, h, p in rules]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in fits)
    ruled = " ".join(f"WHEN {test} THEN '{verdict}'" for test, _, verdict in fits)
    return f"""
    WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        marked AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled,
                   list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS shape FROM split),
        tree AS (SELECT 0 AS level, host, shape, '' AS template, count(*) AS pages, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked
                   FROM marked GROUP BY host, shape
                 UNION ALL
                 SELECT level + 1, host, shape, template || '/' || CASE WHEN segment = '*' OR seen >= {LEAST_PAGES} OR hosts >= {LEAST_HOSTS} THEN segment ELSE '*' END,
                   pages, labelled, blocked
                 FROM (SELECT *, shape[level + 1] AS segment, sum(pages) OVER (PARTITION BY host, template, shape[level + 1]) AS seen,
                   count(DISTINCT host) OVER (PARTITION BY template, shape[level + 1]) AS hosts FROM tree WHERE len(shape) > level)),
        grown AS (SELECT * FROM tree WHERE level = len(shape)),
        branch AS (SELECT host, template, sum(labelled)::DOUBLE AS n, sum(blocked)::DOUBLE AS b FROM grown GROUP BY 1, 2),
        total AS (SELECT (coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS overall FROM branch),
        wide AS (SELECT *, sum(n) OVER (PARTITION BY host) AS host_n, sum(b) OVER (PARTITION BY host) AS host_b,
                   sum(n) OVER (PARTITION BY template) AS all_n, sum(b) OVER (PARTITION BY template) AS all_b FROM branch),
        pooled AS (SELECT *, b / nullif(n, 0) AS own, host_b / nullif(host_n, 0) AS mean,
                   (all_b + {STRENGTH}::DOUBLE * overall) / (all_n + {STRENGTH}::DOUBLE) AS usual FROM wide, total),
        tested AS (SELECT *, coalesce(abs(own - mean) <= {ALIKE}::DOUBLE * sqrt(mean * (1 - mean) * (1 / nullif(n, 0) + 1 / nullif(host_n, 0))), false) AS merged FROM pooled),
        scored AS (SELECT host, template, (CASE WHEN merged THEN host_b ELSE b END + {STRENGTH}::DOUBLE * usual)
                   / (CASE WHEN merged THEN host_n ELSE n END + {STRENGTH}::DOUBLE) AS share FROM tested)
    SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM marked j JOIN grown t ON j.host = t.host AND j.shape = t.shape JOIN scored s ON t.host = s.host AND t.template = s.template"""
