"""DuckDB SQL for the core queries, over the same whole tables."""

from __future__ import annotations

# Literals of the SQL itself, so that it does not follow the code it checks.
NOW, PAGE, LATENCY_BUDGET_MS, CACHE_BYTES = 1_735_689_600, 10, 60_000.0, 1_000_000
_TRACKING = "('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'utm_id', 'fbclid', 'gclid', 'msclkid', 'dclid', 'mc_cid', 'mc_eid', 'ref', 'referrer', 'source', '_ga', '_gl', 'spm')"
_STOP = "string_split('the is at in on to for of and or an it by as be do if no so up how what why who when which this that with from are was were has have had can will does', ' ')"
_SCORES = """('docs.python.org', 1.0), ('developer.mozilla.org', 1.0), ('kubernetes.io', 1.0), ('rust-lang.org', 1.0), ('doc.rust-lang.org', 1.0), ('go.dev', 1.0), ('docs.oracle.com', 1.0), ('learn.microsoft.com', 1.0), ('reactjs.org', 1.0),
('vuejs.org', 1.0), ('arxiv.org', 0.95), ('openalex.org', 0.95), ('scholar.google.com', 0.95), ('dl.acm.org', 0.95), ('ieee.org', 0.90), ('github.com', 0.90), ('gitlab.com', 0.85), ('stackoverflow.com', 0.85), ('stackexchange.com', 0.85),
('en.wikipedia.org', 0.80), ('zh.wikipedia.org', 0.80), ('baijiahao.baidu.com', 0.15), ('jb51.net', 0.15), ('csdn.net', 0.2), ('51cto.com', 0.2), ('cnblogs.com', 0.3), ('bilibili.com', 0.3), ('w3schools.com', 0.3), ('runoob.com', 0.3),
('juejin.cn', 0.35), ('segmentfault.com', 0.35), ('tutorialspoint.com', 0.35), ('zhihu.com', 0.45), ('medium.com', 0.5), ('geeksforgeeks.org', 0.55),
('kavexka.test', 0.9), ('news.kavexka.test', 0.8), ('pelgar.test', 0.95), ('example', 0.6), ('fenbritam.test', 0.4)"""
_WEIGHTS = {"domain_hit": 0.30, "term_coverage": 0.25, "pollution": 0.15, "diversity": 0.10, "latency": 0.10, "cost": 0.10}
_TTL = """CASE WHEN regexp_matches(place, 'arxiv\\.org|openalex\\.org|pubmed|jmlr\\.org|aclanthology\\.org') THEN 365
 WHEN regexp_matches(place, 'docs\\.|developer\\.|go\\.dev|python\\.org|postgresql\\.org|react\\.dev|nextjs\\.org/docs') THEN 7
 WHEN regexp_matches(place, 'news\\.|blog\\.|/blog/') THEN 1 WHEN regexp_matches(place, 'stackoverflow\\.com|github\\.com|wikipedia\\.org') THEN 30 ELSE 3 END * 86400"""
_PLACE = "lower(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '[?#].*$', ''))"
_NOISE = r"""^(\w[\w\s]*[>›/»]\s*){2,}|(?i:^(skip|jump)\s+to\s+(main|content|navigation))|(?i:^subscribe\s+(to\s+|now|for\s+))|(?i:^sign\s+up\s+for\s+(our\s+)?(newsletter|updates))|(?i:^get\s+(our\s+)?newsletter)|(?i:^©\s*\d{4})|(?i:^copyright\s+(©\s*)?\d{4})|(?i:^all\s+rights\s+reserved)|(?i:^(share|tweet|pin)\s+(this|on|to)\s)|(?i:^follow\s+us\s+on\s)"""
_FOUND = {
    "cookie_banner": r"(?i)(accept\s+cookies?|cookie\s+policy|we\s+use\s+cookies)", "subscribe_cta": r"(?i)(subscribe\s+(to|now)|sign\s+up\s+for|newsletter)", "nav_breadcrumb": r"(?i)(breadcrumb|skip\s+to\s+(main|content)|jump\s+to)",
    "copyright": r"(?i)©\s*\d{4}|all\s+rights\s+reserved", "social_share": r"(?i)(share\s+on|tweet\s+this|share\s+this|follow\s+us)", "related_articles": r"(?i)(related\s+(articles?|posts?)|you\s+might\s+also|recommended\s+for)",
    "login_prompt": r"(?i)(log\s*in\s+to|sign\s+in\s+to|create\s+(an\s+)?account)",
}

_ABS = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_P = lambda n, u="url": f"regexp_extract({u}, {_ABS}, {n})"

_Q = f"substr({_P(4)}, 2)"
_DEC = "url_decode(replace({x}, '+', ' '))"
_ENC = "replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"
_PAIRS = f"""list_filter(list_transform(list_filter(string_split({_Q}, '&'), lambda p: p <> '' AND NOT contains(p, ';')), lambda p, i: {{'n': {_DEC.format(x="split_part(p, '=', 1)")}, 'i': i,
  'v': {_ENC.format(x="substr(p, length(split_part(p, '=', 1)) + 2)")}}}), lambda s: lower(s.n) NOT IN {_TRACKING})"""
_KEY = f"""CASE WHEN {_P(1)} <> '' THEN lower({_P(1)}) || '://' || regexp_replace(lower({_P(2)}), '^www\\.', '')
  || CASE WHEN length({_P(3)}) > 1 THEN regexp_replace({_P(3)}, '/+$', '') ELSE {_P(3)} END
  || CASE WHEN {_P(4)} = '?' THEN '?' ELSE coalesce('?' || nullif(array_to_string(list_transform(list_sort({_PAIRS}), lambda s: replace(url_encode(s.n), '%20', '+') || '=' || s.v), '&'), ''), '') END
  ELSE CASE WHEN length(split_part(split_part(url, '#', 1), '?', 1)) > 1 THEN regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') ELSE split_part(split_part(url, '#', 1), '?', 1) END END"""
_DOMAIN = f"coalesce(nullif(regexp_replace(regexp_replace({_P(2)}, ':[0-9]*$', ''), '^www\\.', ''), ''), url)"

_DEDUP = f"""dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, {_KEY} ORDER BY pos, hit_id) AS rn
  FROM search_hits WHERE title <> '' AND url <> '') WHERE rn = 1)"""
_AUTH_TABLE = f"authority AS (SELECT domain, score::DOUBLE AS score FROM (VALUES {_SCORES}) t(domain, score))"
_AUTH = f"""coalesce((SELECT arg_max(a.score, length(a.domain)) FROM authority a WHERE lower({_P(2, 'h.url')}) = a.domain OR ends_with(lower({_P(2, 'h.url')}), '.' || a.domain)),
  CASE WHEN starts_with(lower({_P(2, 'h.url')}), 'docs.') THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END)"""
_STEPS = "CASE WHEN strlen(coalesce(h.snippet, '')) >= 200 THEN 1.0 WHEN strlen(coalesce(h.snippet, '')) >= 100 THEN 0.8 WHEN strlen(coalesce(h.snippet, '')) >= 50 THEN 0.5 WHEN strlen(coalesce(h.snippet, '')) >= 1 THEN 0.3 ELSE 0.0 END"
_SCORED = f"""{_AUTH_TABLE}, {_DEDUP},
hosts AS (SELECT DISTINCT url FROM dedup), host_authority AS (SELECT h.url, {_AUTH} AS authority FROM hosts h),
asked AS (SELECT question_id, list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: strlen(t) >= 2 AND NOT list_contains({_STOP}, t)) AS toks FROM questions),
scored AS (SELECT h.*, ha.authority AS authority,
  round(0.4 * ha.authority + 0.4 * CASE WHEN coalesce(len(toks), 0) > 0
    THEN len(list_filter(toks, lambda t: contains(lower(coalesce(h.title, '') || ' ' || coalesce(h.snippet, '')), t)))::DOUBLE / len(toks) ELSE 0.0 END
  + 0.2 * {_STEPS}, 9) AS score FROM dedup h JOIN host_authority ha ON ha.url = h.url LEFT JOIN asked ON asked.question_id = h.question_id)"""

_PICK = """picked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos, hit_id) AS source_no FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN t <= {k} THEN 0 ELSE 1 END, score DESC, pos, hit_id) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, source_type ORDER BY score DESC, pos, hit_id) AS t FROM {src})) WHERE n <= {n})"""

_MODULE = "search_hits WHERE module = '{m}' AND question_id IS NOT NULL AND title <> '' AND url <> ''"
_TASK = f"question_id::VARCHAR || '-' || floor(pos / {PAGE})::BIGINT::VARCHAR"
_POS = f"(SELECT *, (row_number() OVER (PARTITION BY question_id, floor(pos / {PAGE}) ORDER BY pos, hit_id) - 1)::INTEGER AS place FROM search_hits WHERE module = '{{m}}' AND question_id IS NOT NULL) WHERE title <> '' AND url <> ''"
_TRIM = r"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
_LINE = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, content_id DESC) AS rn FROM content_cache) WHERE rn = 1)"
_C = "coalesce(content, '')"
_FLAGS = ", ".join(f"CASE WHEN regexp_matches({_C}, '{p}') THEN '{n}' END" for n, p in _FOUND.items())
_PARAS = f"len(list_filter(list_transform(string_split({_C}, chr(10) || chr(10)), lambda p: trim(p, ' ')), lambda p: strlen(p) > 20))"
_TAGS = f"len(regexp_extract_all({_C}, '<[a-zA-Z][^>]*>'))"

_FIRST = """tried AS (SELECT * FROM fetch_attempts WHERE enabled),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY layer_order, attempt_id) AS rn FROM tried WHERE ok) WHERE rn = 1),
failed AS (SELECT DISTINCT t.url, t.layer_order, t.layer, t.err_kind FROM tried t LEFT JOIN won w ON w.url = t.url WHERE NOT t.ok AND (w.url IS NULL OR t.layer_order < w.layer_order)),
listed AS (SELECT url, string_agg(layer || ':' || coalesce(err_kind, 'unknown'), ', ' ORDER BY layer_order, layer, err_kind NULLS FIRST) AS errors FROM failed GROUP BY url),
chain AS (SELECT u.url, w.layer, w.layer_order, w.content_type, w.latency_ms, coalesce(l.errors, '') AS errors
  FROM (SELECT DISTINCT url FROM tried) u LEFT JOIN won w ON w.url = u.url LEFT JOIN listed l ON l.url = u.url)"""

_BODY = f"""trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split({_C}, chr(10)),
  lambda line: NOT regexp_matches(trim(line, ' '), '{_NOISE}')), chr(10)), '\\n{{2,}}', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), ' ')"""
_HEAD = "list_filter(list_transform(string_split({c}, chr(10))[1:20], lambda x: trim(x, ' ')), lambda x: starts_with(x, '# '))"

_MEASURED = f"""{_AUTH_TABLE}, base AS (SELECT * FROM search_hits WHERE question_id IS NOT NULL AND domain IS NOT NULL),
truth AS (SELECT question_id, list(domain ORDER BY domain) AS required FROM (SELECT question_id, domain, row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, domain) AS k
  FROM base GROUP BY question_id, domain) WHERE k <= 3 GROUP BY question_id),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, {_KEY} ORDER BY pos, hit_id) AS rn FROM base) WHERE rn = 1),
urls AS (SELECT DISTINCT url FROM dd), ha AS (SELECT h.url, {_AUTH} AS authority FROM urls h),
rated AS (SELECT dd.*, ha.authority AS score FROM dd JOIN ha ON ha.url = dd.url),
{_PICK.format(k=3, n=10, src='rated')},
cited AS (SELECT question_id, list({_DOMAIN} ORDER BY source_no) AS d, list(source_type ORDER BY source_no) FILTER (WHERE source_type IS NOT NULL) AS kinds, count(*) AS n FROM picked GROUP BY question_id),
b AS (SELECT q.question_id, q.category, q.query, t.required, c.d, coalesce(c.kinds, []) AS kinds, c.n,
  list_distinct(list_filter(list_transform(string_split(q.query, ' '), lambda x: lower(trim(x, ' '))), lambda x: x <> '')) AS terms
  FROM questions q JOIN truth t ON t.question_id = q.question_id JOIN cited c ON c.question_id = q.question_id),
m AS (SELECT question_id, category,
  len(list_filter(required, lambda p: len(list_filter(d, lambda x: lower(x) = lower(p) OR ends_with(lower(x), '.' || lower(p)))) > 0))::DOUBLE / len(required) AS domain_hit,
  CASE WHEN len(terms) = 0 THEN 1.0 ELSE len(list_filter(terms, lambda t: contains(lower(array_to_string(d, ' ')), t)))::DOUBLE / len(terms) END AS term_coverage,
  1 - len(list_filter(d, lambda x: lower(x) = 'invalid' OR ends_with(lower(x), '.invalid')))::DOUBLE / len(d) AS pollution,
  (list_contains(kinds, 'general_web')::INT + list_contains(kinds, 'code')::INT) / 2.0::DOUBLE AS diversity,
  CASE WHEN length(query) <= 0 THEN 1.0 ELSE 1 - least(length(query) * 500.0::DOUBLE / {LATENCY_BUDGET_MS}, 1.0) END AS latency,
  1 - least(n * 0.05::DOUBLE / 0.5::DOUBLE, 1.0) AS cost FROM b),
scores AS (SELECT *, greatest(0.0, least(100.0, 100 * ({' + '.join(f'{w} * {k}' for k, w in _WEIGHTS.items())}))) AS composite FROM m)"""
_METRICS = list(_WEIGHTS)
_AVG = ", ".join(f"round(avg({c}), 4) AS avg_{c}" for c in _METRICS)
_ROLLUP = f"count(*) AS n, round(avg(c), 4) AS mean, round(quantile_disc(c, 0.5), 4) AS p50, round(quantile_disc(c, 0.95), 4) AS p95, {_AVG}"

_ARTICLES = r"""WITH e AS (SELECT content_id, content, content_type, title, {body} AS b FROM content_cache {where}),
  t AS (SELECT *, substr(b, 1, 20000) AS head, regexp_extract(substr(b, 1, 20000), '(?s)^(.*)[ \n\t]', 1) AS word FROM e),
  x AS (SELECT content_id, coalesce(nullif(trim(title, ' '), ''), nullif(trim(substr({head}[1], 3), ' '), '')) AS title, b,
    CASE WHEN strlen(b) >= 200 THEN CASE WHEN length(b) > 20000 THEN CASE WHEN length(word) > 15000 THEN word ELSE head END || chr(10) || '[content truncated]' ELSE b END END AS t FROM t)
  SELECT content_id, title, md5(t) AS digest, length(t) AS chars, CASE WHEN b = '' THEN 'empty' WHEN t IS NULL THEN 'too short' END AS error FROM x"""

SQL = {
    "url_keys": f"SELECT hit_id, {_KEY} AS url_key, {_DOMAIN} AS domain_of_url FROM search_hits",
    "deduplicated_hits": f"WITH {_DEDUP} SELECT hit_id, question_id, pos, url FROM dedup",
    "scored_hits": f"WITH {_SCORED} SELECT hit_id, authority, round(score, 6) AS score FROM scored",
    "select_sources": f"WITH {_SCORED}, {_PICK.format(k=10, n=25, src='scored')} SELECT question_id, source_no, hit_id, source_type, round(score, 6) AS score FROM picked",
    "planned_tasks": """WITH asked AS (SELECT DISTINCT question_id, source_type, query FROM search_hits WHERE question_id IS NOT NULL AND source_type IS NOT NULL AND query <> '')
SELECT name, count(*) AS tasks, count(DISTINCT question_id) AS questions FROM asked JOIN module_manifests USING (source_type) GROUP BY name""",
    "web_results": f"SELECT {_TASK} AS task_id, place AS pos, title, url, snippet FROM {_POS.format(m='bravura')}",
    "organic_results": f"SELECT {_TASK} AS task_id, place AS pos, title, url, snippet FROM {_POS.format(m='serpline')}",
    "highlight_results": f"SELECT {_TASK} AS task_id, place AS pos, title, url, regexp_replace(coalesce(snippet, ''), '[.]\\s', '. ', 'g') AS snippet FROM {_POS.format(m='exalt')}",
    "repository_results": f"""SELECT {_TASK} AS task_id, place AS pos, title, url,
  coalesce('[' || nullif(source_type, '') || '] ', '') || coalesce(snippet, '') || ' (' || (hit_id % 1000)::VARCHAR || ' stars)' AS snippet FROM {_POS.format(m='repohub')}""",
    "feed_results": f"""SELECT {_TASK} AS task_id, {_LINE.format(c='title')} AS title, url, module || ', ' || coalesce(source_type, '') || ' — ' || {_LINE.format(c="coalesce(snippet, '')")} AS snippet
  FROM {_MODULE.format(m='paperfind')}""",
    "page_results": f"SELECT {_TASK} AS task_id, title, url, coalesce(snippet, '') AS snippet FROM {_MODULE.format(m='quackle')}",
    "fetch_chain": f"WITH {_FIRST} SELECT * FROM chain",
    "layer_report": """SELECT layer, count(*) AS tries, count(*) FILTER (WHERE ok) AS wins, floor(avg(latency_ms) FILTER (WHERE latency_ms >= 0))::BIGINT AS mean_ms,
  quantile_disc(latency_ms, 0.5) FILTER (WHERE latency_ms >= 0) AS p50_ms, quantile_disc(latency_ms, 0.95) FILTER (WHERE latency_ms >= 0) AS p95_ms FROM fetch_attempts WHERE enabled GROUP BY layer""",
    "success_by_type": f"""WITH {_FIRST} SELECT trim(split_part(lower(content_type), ';', 1)) AS media_type, count(*) AS urls, count(*) FILTER (WHERE layer IS NOT NULL) AS fetched FROM chain GROUP BY 1""",
    "layer_share": "SELECT layer_used, count(*) AS pages, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share FROM content_cache GROUP BY layer_used",
    "content_quality": f"""SELECT layer_used, count(*) AS pages, count(*) FILTER (WHERE coalesce(trim(title), '') <> '') AS titled,
  count(*) FILTER (WHERE len(list_filter([{_FLAGS}], lambda x: x IS NOT NULL)) = 0) AS noiseless, count(*) FILTER (WHERE {_TAGS} = 0) AS tagless,
  count(*) FILTER (WHERE NOT contains({_C}, '�')) AS encoded, floor(avg({_PARAS}))::BIGINT AS mean_paragraphs, floor(avg(strlen({_C})))::BIGINT AS mean_bytes FROM content_cache GROUP BY layer_used""",
    "noise_of_pages": f"SELECT content_id, array_to_string(list_filter([{_FLAGS}], lambda x: x IS NOT NULL), ', ') AS noise_found, {_TAGS}::INTEGER AS tag_count FROM content_cache",
    "extracted_pages": _ARTICLES.format(body=_BODY, head=_HEAD.format(c="b"), where=""),
    "extracted_texts": _ARTICLES.format(
        body=r"""regexp_replace(CASE WHEN coalesce(content_type, '') ILIKE '%text/markdown%' THEN regexp_replace(regexp_replace(content, '\n{2,}', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g') ELSE regexp_replace(content, '\n{2,}', chr(10), 'g') END, '^\s+|\s+$', '', 'g')""",
        head=_HEAD.format(c="CASE WHEN coalesce(content_type, '') ILIKE '%text/markdown%' THEN content END"), where="WHERE NOT coalesce(contains(lower(content_type), 'text/html'), false)",
    ),
    "cache_state": f"SELECT url, content_id, fetched_at, layer_used, strlen(content) AS bytes FROM {_LAST}",
    "cache_lookup": f"""WITH asked AS (SELECT DISTINCT url, source_type FROM search_hits WHERE url <> ''), live AS (SELECT url FROM {_LAST} WHERE fetched_at + ttl_seconds > {NOW})
SELECT source_type, count(*) AS urls, count(live.url) AS from_cache FROM asked LEFT JOIN live ON live.url = asked.url GROUP BY source_type""",
    "cache_ttl": f"WITH p AS (SELECT {_PLACE} AS place FROM content_cache) SELECT {_TTL} AS ttl, count(*) AS pages FROM p GROUP BY 1",
    "cache_evicted": f"SELECT url, fetched_at FROM (SELECT url, fetched_at, row_number() OVER (ORDER BY fetched_at, url) AS k, count(*) OVER () AS n FROM {_LAST}) WHERE k <= greatest(floor(n * 0.1), 1)",
    "source_prompts": f"""WITH pages AS (SELECT h, content FROM (SELECT lower({_DOMAIN}) AS h, content, row_number() OVER (PARTITION BY lower({_DOMAIN}) ORDER BY fetched_at DESC, content_id DESC) AS rn FROM content_cache) WHERE rn = 1),
s AS (SELECT j.*, 'https://' || lower({_DOMAIN}) AS u FROM json_sources j),
f AS (SELECT s.*, p.content, row_number() OVER (PARTITION BY run_id ORDER BY id, row_id) AS n FROM s JOIN pages p ON s.u = 'https://' || p.h WHERE p.content IS NOT NULL)
SELECT run_id, count(*)::INTEGER AS n_sources, md5(string_agg('SOURCE ' || id || ' [' || coalesce(source_type, '') || ' / score ' || printf('%.2f', round(coalesce(score, 0)::DECIMAL(18, 9), 2)) || ']' || chr(10) || 'URL: ' || coalesce(u, '')
  || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Content:' || chr(10) || CASE WHEN length(content) > 8000 THEN substr(content, 1, 8000) || chr(10) || '[content truncated]' ELSE content END || chr(10) || chr(10), '' ORDER BY n)) AS digest
FROM f WHERE n <= 25 GROUP BY run_id""",
    "merged_citations": """WITH r AS (SELECT * FROM json_sources WHERE url <> ''),
c AS (SELECT * FROM (SELECT run_id, url, id, row_number() OVER (PARTITION BY run_id, url ORDER BY id, row_id) AS k FROM r WHERE id <= 5) WHERE k = 1),
f AS (SELECT * FROM (SELECT run_id, url, id, row_id, row_number() OVER (PARTITION BY run_id, url ORDER BY id, row_id) AS k FROM r WHERE fetched) WHERE k = 1),
t AS (SELECT run_id, greatest(max(id), 0) AS top FROM c GROUP BY run_id)
SELECT run_id, url, id AS rank FROM c UNION ALL
SELECT f.run_id, f.url, coalesce(t.top, 0) + row_number() OVER (PARTITION BY f.run_id ORDER BY f.id, f.row_id) AS rank FROM f LEFT JOIN t ON t.run_id = f.run_id
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.run_id = f.run_id AND c.url = f.url)""",
    "answer_texts": """SELECT question_id, CASE WHEN question_id % 4 < 2 THEN 'see C:Work on ' || question_id WHEN question_id % 4 = 2 THEN 'see C:' || chr(92) || 'Work on ' || question_id END AS answer,
  CASE WHEN question_id % 4 < 3 THEN 'https://a.example/' || question_id END AS first_url,
  CASE WHEN question_id % 4 < 3 AND difficulty IN ('high', 'medium', 'low', 'insufficient') THEN difficulty ELSE 'medium' END AS confidence,
  CASE WHEN question_id % 4 = 3 THEN 'invalid answer JSON' END AS error FROM questions WHERE question_id IS NOT NULL""",
    "question_scores": f"WITH {_MEASURED} SELECT question_id, {', '.join(f'round({c}, 6) AS {c}' for c in [*_METRICS, 'composite'])} FROM scores",
    "category_report": f"""WITH {_MEASURED}, r AS (SELECT *, round(composite, 6) AS c FROM scores)
SELECT category, {_ROLLUP} FROM r WHERE category IS NOT NULL GROUP BY category UNION ALL SELECT NULL, {_ROLLUP} FROM r""",
    "extreme_questions": f"""WITH {_MEASURED}, r AS (SELECT question_id, round(composite, 6) AS composite FROM scores)
(SELECT 'worst' AS side, * FROM r ORDER BY composite, question_id LIMIT 10) UNION ALL (SELECT 'best', * FROM r ORDER BY composite DESC, question_id LIMIT 10)""",
    "validation_issues": f"""WITH i AS (SELECT unnest(list_filter([CASE WHEN question_id IS NULL THEN 'no question' END, CASE WHEN coalesce(title, '') = '' THEN 'no title' END,
  CASE WHEN coalesce(snippet, '') = '' THEN 'no snippet' END, CASE WHEN source_type IS NULL THEN 'no source type' END, CASE WHEN loaded_at > found_at + INTERVAL 1 DAY THEN 'loaded late' END,
  CASE WHEN domain IS NOT NULL AND NOT (lower({_DOMAIN}) <> '' AND domain <> '' AND (lower({_DOMAIN}) = lower(domain) OR ends_with(lower({_DOMAIN}), '.' || lower(domain)))) THEN 'domain differs' END],
  lambda x: x IS NOT NULL)) AS rule FROM search_hits) SELECT rule, count(*) AS n FROM i GROUP BY rule""",
    "numbered_sources": "SELECT run_id, row_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, row_id) AS place FROM json_sources WHERE score IS NOT NULL",
    "hourly_hits": "SELECT epoch(date_trunc('hour', found_at))::BIGINT AS start, module, count(*) AS hits FROM search_hits WHERE found_at IS NOT NULL GROUP BY 1, 2",
    "question_results": f"""SELECT {_TASK} AS task_id, place AS pos, title, url, concat_ws(' | ', concat_ws(', ', source_type, module), 'Score: ' || (hit_id % 50),
  CASE WHEN hit_id % 4 = 0 THEN 'unanswered' ELSE (hit_id % 4) || ' answers' || CASE WHEN hit_id % 4 = 3 THEN ' (accepted)' ELSE '' END END) AS snippet FROM {_POS.format(m='stackask')}""",
    "webpage_results": f"SELECT {_TASK} AS task_id, place AS pos, title, url, snippet FROM {_POS.format(m='metanook')}",
    "listed_results": f"SELECT {_TASK} AS task_id, {_TRIM.format(c='title')} AS title, url, {_TRIM.format(c='snippet')} AS snippet FROM {_MODULE.format(m='webscout')}",
    "container_results": f"SELECT {_TASK} AS task_id, {_TRIM.format(c='title')} AS title, url, {_TRIM.format(c='snippet')} AS snippet FROM {_MODULE.format(m='hanseek')} AND question_id % 7 <> 0",
    "collected_hits": f"""SELECT module, (SELECT m.source_type FROM module_manifests m WHERE m.name = h.module) AS source_type, count(*) AS hits, count(DISTINCT {_TASK}) AS tasks FROM search_hits h
  WHERE module IN ('bravura', 'serpline', 'metanook', 'exalt') AND question_id IS NOT NULL AND title <> '' AND url <> '' GROUP BY module""",
    "enabled_tasks": """WITH asked AS (SELECT DISTINCT question_id, source_type, query FROM search_hits WHERE question_id IS NOT NULL AND source_type IS NOT NULL AND query <> '')
SELECT name, m.source_type, count(*) AS tasks FROM asked JOIN module_manifests m USING (source_type) WHERE name IN ('bravura', 'paperfind', 'stackask') GROUP BY name, m.source_type""",
    "payload_errors": """SELECT module, CASE hit_id % 8 WHEN 0 THEN 'blocked' WHEN 1 THEN 'quota' WHEN 2 THEN 'not_found' WHEN 3 THEN 'transport' WHEN 4 THEN 'unknown' WHEN 5 THEN 'api error' WHEN 6 THEN 'api error' END AS error,
  count(*) AS answers FROM search_hits GROUP BY 1, 2""",
    "recovered_plans": """SELECT question_id, CASE question_id % 7 WHEN 0 THEN 'general_web' WHEN 1 THEN 'academic,community' WHEN 2 THEN 'code' WHEN 3 THEN 'docs' END AS kinds,
  CASE WHEN question_id % 7 = 1 THEN 2 WHEN question_id % 7 < 4 THEN 1 END * CASE WHEN coalesce(query, '') = '' AND question_id % 7 <> 2 THEN 1 ELSE 2 END AS n,
  CASE question_id % 7 WHEN 4 THEN 'invalid plan JSON' WHEN 5 THEN 'zero queries' WHEN 6 THEN 'missing queries' END AS error FROM questions WHERE question_id IS NOT NULL""",
    "plan_checks": """WITH k AS (SELECT question_id % 7 AS k FROM questions WHERE question_id IS NOT NULL AND question_id % 7 IN (0, 3, 5, 6)),
i AS (SELECT 'missing rationale' AS issue FROM k UNION ALL SELECT 'missing expected_answer_shape' FROM k UNION ALL SELECT 'missing queries_by_source_type' FROM k WHERE k <> 5
  UNION ALL SELECT 'unknown ' || CASE k WHEN 0 THEN 'queries' WHEN 3 THEN 'search' ELSE 'note' END FROM k WHERE k <> 5) SELECT issue, count(*) AS plans FROM i GROUP BY issue""",
    "retried_plans": """WITH q AS (SELECT question_id AS i, least(question_id % 5 + 1, 4) AS first FROM questions WHERE question_id IS NOT NULL),
w AS (SELECT *, CASE WHEN i % 5 = 0 AND i % 11 = 0 THEN 2 ELSE first END AS won FROM q), u AS (SELECT *, least(won, 3) AS used FROM w)
SELECT i AS question_id, used AS attempt, CASE WHEN won <= 3 THEN 1 END AS kinds, CASE WHEN won > 3 THEN 'invalid plan JSON' END AS error, (i % 100) * (used - (i % 11 = 0)::INT) AS input_tokens,
  used * (used + 1) // 2 - (i % 11 = 0)::INT AS output_tokens, 7 * (used - (i % 11 = 0)::INT) AS cached_tokens FROM u""",
    "plan_sizes": """WITH asked AS (SELECT DISTINCT question_id, source_type, query FROM search_hits WHERE question_id IS NOT NULL AND source_type IS NOT NULL AND query <> '')
SELECT question_id, count(*)::INTEGER AS queries, count(DISTINCT source_type)::INTEGER AS kinds FROM asked GROUP BY question_id""",
    "fetched_counts": "SELECT run_id, count(*) AS sources, count(*) FILTER (WHERE fetched) AS fetched, round(100.0::DOUBLE * count(*) FILTER (WHERE fetched) / count(*), 1) AS rate FROM json_sources GROUP BY run_id",
    "success_by_difficulty": f"""WITH {_FIRST} SELECT ['easy', 'medium', 'hard'][length(url) % 3 + 1] AS difficulty, count(*) AS urls, count(layer) AS fetched, coalesce(floor(avg(latency_ms) FILTER (WHERE latency_ms >= 0))::BIGINT, 0) AS mean_ms,
  round(100.0::DOUBLE * count(layer) / count(*), 1) AS rate FROM chain GROUP BY 1""",
    "success_by_layer": f"WITH {_FIRST} SELECT layer, count(*) AS urls, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share FROM chain WHERE layer IS NOT NULL GROUP BY layer",
    "attempt_errors": """SELECT CASE attempt_id % 10 WHEN 0 THEN 'blocked' WHEN 1 THEN 'not_found' WHEN 2 THEN 'transport' WHEN 3 THEN NULL ELSE 'unknown' END AS by_status,
  CASE WHEN err_kind = 'timeout' THEN 'timeout' WHEN attempt_id % 10 = 7 THEN 'canceled' ELSE 'transport' END AS by_transport,
  (attempt_id % 2 = 1 OR (attempt_id % 10 >= 3 AND (attempt_id % 10 = 4 OR attempt_id % 10 >= 5))) AS whole, count(*) AS attempts FROM fetch_attempts WHERE NOT ok GROUP BY 1, 2, 3""",
    "url_forms": f"""SELECT hit_id, CASE WHEN hit_id % 5 = 4 THEN NULL WHEN hit_id % 5 = 2 THEN 'https://third.test/' WHEN {_P(1)} = '' THEN CASE hit_id % 5 WHEN 0 THEN '/next?x=1' WHEN 1 THEN '//other.test/a' ELSE 'page2' END
  WHEN hit_id % 5 = 0 THEN {_P(1)} || '://' || {_P(2)} || '/next?x=1' WHEN hit_id % 5 = 1 THEN {_P(1)} || '://other.test/a'
  ELSE {_P(1)} || '://' || {_P(2)} || coalesce(nullif(regexp_replace({_P(3)}, '[^/]*$', ''), ''), '/') || 'page2' END AS target, 'https://archive.test/web/2020id_/' || url AS snapshot FROM search_hits""",
    "short_titles": f"""SELECT hit_id, replace(CASE WHEN length({_LINE.format(c='title')}) > 40 THEN substr({_LINE.format(c='title')}, 1, 37) || '...' ELSE {_LINE.format(c='title')} END, '|', chr(92) || '|') AS cell FROM search_hits""",
    "latency_texts": """WITH l AS (SELECT attempt_id, latency_ms * (attempt_id % 40) AS ms FROM fetch_attempts) SELECT attempt_id, CASE WHEN ms IS NULL OR ms < 0 THEN '-' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms // 1000) || '.' || ((ms // 100) % 10) || 's'
  ELSE (ms // 60000) || 'm' || lpad(((ms // 1000) % 60)::VARCHAR, 2, '0') || 's' END AS took FROM l""",
    "hit_previews": "SELECT question_id, hit_id, n::INTEGER AS n FROM (SELECT question_id, hit_id, row_number() OVER (PARTITION BY question_id ORDER BY pos, hit_id) AS n FROM search_hits) WHERE n <= 3",
    "repeated_titles": """SELECT hit_id, first_hit FROM (SELECT hit_id, first_value(hit_id) OVER (PARTITION BY question_id, lower(trim(title, ' ')) ORDER BY pos, hit_id) AS first_hit FROM search_hits WHERE title <> '') WHERE hit_id <> first_hit""",
    "top_citations": """SELECT run_id, question_id, (n - 1)::INTEGER AS n, row_id FROM (SELECT run_id, question_id, row_id, row_number() OVER (PARTITION BY run_id, question_id ORDER BY (row_id % 6 = 0 OR id <= 0), CASE WHEN row_id % 6 <> 0 AND id > 0 THEN id ELSE 0 END, row_id) AS n
  FROM json_sources WHERE question_id IS NOT NULL) WHERE n <= 5""",
    "cache_flow": f"""WITH last AS {_LAST}, urls AS (SELECT DISTINCT url FROM content_cache WHERE url IS NOT NULL),
live AS (SELECT * FROM last WHERE content_id % 2 = 0 AND fetched_at + ttl_seconds > {NOW}), got AS (SELECT * FROM last WHERE content_id % 3 <> 0),
r AS (SELECT u.url, l.url IS NOT NULL AS from_cache, CASE WHEN l.url IS NOT NULL THEN l.layer_used ELSE g.layer_used END AS layer_used, l.url IS NULL AND g.url IS NOT NULL AS put, {_PLACE.replace('url', 'u.url')} AS place
  FROM urls u LEFT JOIN live l ON l.url = u.url LEFT JOIN got g ON g.url = u.url)
SELECT from_cache, layer_used, CASE WHEN put THEN {_TTL} END AS ttl_seconds, count(*) AS urls FROM r GROUP BY 1, 2, 3""",
    "cache_full": f"""SELECT url, fetched_at FROM (SELECT url, fetched_at, row_number() OVER (ORDER BY fetched_at, url) AS k, count(*) OVER () AS n, sum(strlen(content) + strlen(url)) OVER () AS bytes FROM {_LAST})
  WHERE bytes > {CACHE_BYTES} AND k <= greatest(floor(n * 0.1), 1)""",
    "set_issues": """WITH n AS (SELECT question_id, list(DISTINCT domain) AS domains, list(DISTINCT source_type) FILTER (WHERE source_type IS NOT NULL) AS kinds FROM search_hits WHERE question_id IS NOT NULL AND domain IS NOT NULL GROUP BY question_id),
q AS (SELECT q.question_id AS pos, CASE WHEN q.question_id % 9 = 0 THEN 'same' ELSE query_id END AS query_id, q.question_id % 9 AS k, category, CASE WHEN q.question_id % 9 = 1 THEN 'comparison' ELSE category END AS type, query, lang, difficulty, tech_area,
  least(len(coalesce(domains, [])), 5) AS nd, string_split(query, ' ')[1:5] AS terms, CASE WHEN q.question_id % 9 <> 4 THEN coalesce(kinds, []) ELSE [] END AS kinds FROM questions q LEFT JOIN n ON n.question_id = q.question_id),
t AS (SELECT *, list_transform(coalesce(terms, []), lambda x: lower(trim(x, ' '))) AS tt FROM q),
i AS (SELECT query_id, unnest(list_filter([CASE WHEN coalesce(query, '') = '' THEN 'empty query' END, CASE WHEN coalesce(lang, '') = '' THEN 'empty intent' END, CASE WHEN coalesce(tech_area, '') = '' THEN 'empty tech_area' END,
  CASE WHEN k = 2 OR coalesce(query, '') = '' THEN 'empty canonical_answer' END, CASE WHEN coalesce(query_id, '') = '' THEN 'empty id' END, CASE WHEN coalesce(type, '') <> coalesce(category, '') THEN 'type differs from category' END,
  CASE WHEN coalesce(category, '') NOT IN ('error_troubleshooting', 'api_usage', 'version_compatibility', 'concept_explanation', 'comparison', 'fuzzy_recall', 'time_sensitive') THEN 'invalid category' END,
  CASE WHEN coalesce(difficulty, '') NOT IN ('easy', 'medium', 'hard') THEN 'invalid difficulty' END, CASE WHEN nd NOT BETWEEN 2 AND 4 THEN 'must_contain_domains count' END, CASE WHEN len(tt) NOT BETWEEN 2 AND 5 THEN 'must_contain_terms count' END,
  CASE WHEN len(kinds) < 1 THEN 'expected_source_types empty' END, CASE WHEN len(list_filter(kinds, lambda x: x NOT IN ('general_web', 'academic', 'code', 'community', 'docs'))) > 0 THEN 'invalid source_type' END,
  CASE WHEN len(list_filter(tt, lambda x: x = '')) > 0 THEN 'must_contain_terms empty entry' END, CASE WHEN len(list_distinct(list_filter(tt, lambda x: x <> ''))) < len(list_filter(tt, lambda x: x <> '')) THEN 'must_contain_terms duplicate' END,
  CASE WHEN k = 3 THEN 'forbidden_domains duplicate' END], lambda x: x IS NOT NULL)) AS issue FROM t UNION ALL
  SELECT query_id, 'duplicate id' FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM q WHERE query_id <> '') WHERE rn > 1)
SELECT issue, count(*) AS n, count(DISTINCT query_id) AS ids FROM i GROUP BY issue""",
    "conversation_texts": """WITH h AS (SELECT question_id, url AS content, row_number() OVER (PARTITION BY question_id ORDER BY pos, hit_id) AS turn FROM search_hits WHERE question_id IS NOT NULL),
m AS (SELECT question_id, 0 AS turn, query AS content FROM questions UNION ALL SELECT question_id, turn, content FROM h WHERE turn <= 3)
SELECT question_id, arg_min(content, turn) AS first, count(*)::INTEGER AS messages FROM m WHERE content <> '' GROUP BY question_id""",
    "result_texts": """WITH n AS (SELECT run_id, count(*) FILTER (WHERE fetched) AS fetched, max(title) AS title FROM json_sources GROUP BY run_id)
SELECT run_id, CASE WHEN run_id % 3 = 0 AND trim(coalesce(title, '')) <> '' THEN 'answer' WHEN fetched > 0 THEN 'sources' ELSE 'empty' END AS mode,
  '{' || array_to_string(list_filter([CASE WHEN run_id <> 0 THEN '"run_id":' || run_id END, CASE WHEN run_id % 2 = 0 AND fetched <> 0 THEN '"fetched":' || fetched END], lambda x: x IS NOT NULL), ',') || '}' AS result FROM n""",
    "report_rows": """SELECT query_id, 'no hits' AS error, coalesce(nullif(list_position(['error_troubleshooting', 'api_usage', 'version_compatibility', 'concept_explanation', 'comparison', 'fuzzy_recall', 'time_sensitive'], category), 0), 8)::BIGINT AS place
  FROM questions q WHERE NOT EXISTS (SELECT 1 FROM search_hits h WHERE h.question_id = q.question_id)""",
    "variant_results": f"""WITH {_SCORED.replace('search_hits WHERE title', 'search_hits WHERE question_id IS NOT NULL AND title')}, {_PICK.format(k=10, n=25, src='scored')},
p AS (SELECT DISTINCT lower({_DOMAIN}) AS h FROM content_cache WHERE url IS NOT NULL),
b AS (SELECT question_id, lower({_DOMAIN}) AS h FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos, hit_id) AS n FROM dedup) WHERE n <= 3),
r AS (SELECT question_id, 'baseline' AS variant, h FROM b UNION ALL SELECT question_id, 'selected', lower({_DOMAIN}) FROM picked)
SELECT question_id, variant, count(*) AS sources, count(p.h) AS fetched, count(p.h) > 0 AS prompted FROM r LEFT JOIN p ON p.h = r.h GROUP BY question_id, variant""",
}
