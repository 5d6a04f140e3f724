"""DuckDB SQL for the numbered problems' queries, where SQL can state them over whole tables."""

_HOST = r"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '^www\.', ''), '')"""
_KIND = "replace(lower(trim(source_type)), '-', '_')"

_OVER = f"""
WITH base AS (SELECT run_id, row_id, score, {_HOST} AS d, {_KIND} AS t, count(*) OVER (PARTITION BY run_id) AS n FROM json_sources),
long AS (SELECT 'domain' AS contributor_kind, d AS c, run_id, row_id, score, n FROM base WHERE d IS NOT NULL
  UNION ALL SELECT 'source_type', t, run_id, row_id, score, n FROM base WHERE t IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY contributor_kind, run_id, c ORDER BY score DESC NULLS LAST, row_id) AS k FROM long),
over_cap AS (SELECT contributor_kind, row_id FROM ranked JOIN source_caps USING (contributor_kind)
  WHERE k > least(coalesce(max_records, 9e15), coalesce(floor(max_share * n), 9e15)))
"""

SQL = {
    "p5_found": _OVER + "SELECT contributor_kind, row_id FROM over_cap",
    "p5_capped": _OVER + f"SELECT run_id, row_id, {_HOST} AS host, {_KIND} AS kind, score FROM json_sources WHERE row_id NOT IN (SELECT row_id FROM over_cap)",
}
