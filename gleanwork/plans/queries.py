"""Registered queries of the core operators; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions import texts, urls
from gleanwork.operators import answers, cache, fetching, hits, ranking, scoring
from gleanwork.plans import pipeline
from gleanwork.session import table, written
from gleanwork.sources import payloads
from gleanwork.streaming import cache_stream
from gleanwork.values import ANSWER_WEIGHTS, DOMAIN_SCORES

#: Parameters of the queries: scores of hosts besides the fixed ones, the time, budgets, places of a page of results.
AUTHORITY = DOMAIN_SCORES | {"kavexka.test": 0.9, "news.kavexka.test": 0.8, "pelgar.test": 0.95, "example": 0.6, "fenbritam.test": 0.4}
NOW = 1_735_689_600
LATENCY_BUDGET_MS = 60_000.0
PAGE = 10
CACHE_BYTES = 1_000_000
KINDS = ["general_web", "academic", "code", "community", "docs"]


def _hits(spark, d) -> DataFrame:
    return table(spark, d, "search_hits")


def url_keys(spark, d):
    """Key of every hit's url."""
    return _hits(spark, d).select("hit_id", urls.url_key(F.col("url")).alias("url_key"), urls.url_domain(F.col("url")).alias("domain_of_url"))


def deduplicated_hits(spark, d):
    """Hits of distinct pages of each question, the first to arrive kept."""
    return hits.deduplicated(hits.well_formed(_hits(spark, d))).select("hit_id", "question_id", "pos", "url")


def _scored(spark, d):
    return hits.scored(hits.deduplicated(hits.well_formed(_hits(spark, d))), table(spark, d, "questions"), AUTHORITY)


def scored_hits(spark, d):
    """Deduplicated hits with their relevance."""
    return _scored(spark, d).select("hit_id", "authority", F.round("score", 6).alias("score"))


def select_sources(spark, d):
    """Of each question the sources to fetch: 10 of a type, 25 in all."""
    return hits.selected(_scored(spark, d)).select("question_id", "source_no", "hit_id", "source_type", F.round("score", 6).alias("score"))


def _plans(spark, d) -> DataFrame:
    """A plan's JSON for each question, made of the queries its hits came from."""
    asked = _hits(spark, d).where("question_id IS NOT NULL AND source_type IS NOT NULL AND query <> ''").select("question_id", "source_type", "query").distinct()
    by_type = asked.groupBy("question_id", "source_type").agg(F.array_sort(F.collect_list("query")).alias("queries"))
    maps = by_type.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "queries")))).alias("m"))
    envelope = F.to_json(F.struct(F.lit("by type").alias("rationale"), F.col("m").alias("queries_by_source_type"), F.lit("text").alias("expected_answer_shape")))
    fenced = F.concat(F.lit("<think>which sources?</think>\n```json\n"), envelope, F.lit("\n```"))
    raw = F.when(F.col("question_id") % 3 == 0, F.to_json("m")).when(F.col("question_id") % 3 == 1, envelope).otherwise(fenced)
    return maps.select("question_id", raw.alias("raw"))


def planned_tasks(spark, d):
    """Plans parsed and fanned out to the modules of each source type: tasks of each module."""
    read = _plans(spark, d).select("question_id", answers.parsed_plan(F.col("raw")).alias("p")).select("question_id", "p.queries")
    return hits.search_tasks(read, table(spark, d, "module_manifests")).groupBy("name").agg(F.count("*").alias("tasks"), F.count_distinct("question_id").alias("questions"))


def _paged(spark, d, module: str) -> DataFrame:
    """Hits of a module with task_id, a page of at most PAGE positions of a question."""
    rows = _hits(spark, d).where((F.col("module") == module) & F.col("question_id").isNotNull())
    return rows.withColumn("task_id", F.concat_ws("-", F.col("question_id").cast("string"), F.floor(F.col("pos") / PAGE).cast("string")))


def _payload(rows: DataFrame, item, wrap) -> DataFrame:
    listed = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hit_id", item.alias("item")))).alias("l"))
    return listed.select("task_id", wrap(F.transform("l", lambda x: x["item"])).alias("payload"))


def web_results(spark, d):
    """Hits of one module as JSON answers, parsed back."""
    item = F.struct("title", "url", F.col("snippet").alias("description"))
    made = _payload(_paged(spark, d, "bravura"), item, lambda x: F.to_json(F.struct(F.struct(x.alias("results")).alias("web"))))
    return payloads.web_json(made)


def organic_results(spark, d):
    item = F.struct("title", F.col("url").alias("link"), "snippet")
    made = _payload(_paged(spark, d, "serpline"), item, lambda x: F.to_json(F.struct(x.alias("organic_results"))))
    return payloads.organic_json(made)


def highlight_results(spark, d):
    item = F.struct("title", "url", F.split(F.coalesce("snippet", F.lit("")), r"(?<=[.])\s").alias("highlights"))
    made = _payload(_paged(spark, d, "exalt"), item, lambda x: F.to_json(F.struct(x.alias("results"))))
    return payloads.highlights_json(made)


def repository_results(spark, d):
    item = F.struct(F.col("title").alias("full_name"), F.col("url").alias("html_url"), F.col("snippet").alias("description"), F.col("source_type").alias("language"), (F.col("hit_id") % 1000).alias("stargazers_count"))
    made = _payload(_paged(spark, d, "repohub"), item, lambda x: F.to_json(F.struct(x.alias("items"))))
    return payloads.repositories_json(made)


def _escaped(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def feed_results(spark, d):
    """Hits of one module as Atom feeds, parsed back."""
    author = F.concat(F.lit("<author><name>"), _escaped(F.col("module")), F.lit("</name></author><author><name>"), _escaped(F.col("source_type")), F.lit("</name></author>"))
    item = F.concat(F.lit("<entry><title>"), _escaped(F.col("title")), F.lit("</title><summary>"), _escaped(F.col("snippet")), F.lit("</summary>"), author, F.lit('<link rel="alternate" href="'), _escaped(F.col("url")), F.lit('"/></entry>'))
    made = _payload(_paged(spark, d, "paperfind"), item, lambda x: F.concat(F.lit("<feed>"), F.array_join(x, ""), F.lit("</feed>")))
    return payloads.feed_xml(made).select("task_id", "title", "url", "snippet")


def page_results(spark, d):
    """Hits of one module as HTML result pages with redirect links and an advertisement, parsed back."""
    item = F.concat(
        F.lit('<div class="result"><h2><a href="//go.example/l/?uddg='), F.url_encode("url"), F.lit('">'), _escaped(F.col("title")), F.lit('</a></h2><p class="snippet">'), _escaped(F.col("snippet")), F.lit("</p></div>")
    )
    made = _payload(_paged(spark, d, "quackle"), item, lambda x: F.concat(F.lit('<div class="result result--ad"><a href="https://ad.example/">Ad</a></div>'), F.array_join(x, "\n")))
    return payloads.result_page(made).select("task_id", "title", "url", "snippet")


def fetch_chain(spark, d):
    """The layer that won for each url, and the failures before it."""
    return fetching.first_success(table(spark, d, "fetch_attempts"))


def layer_report(spark, d):
    """Tries, wins and latencies of each layer."""
    return fetching.layer_report(table(spark, d, "fetch_attempts"))


def success_by_type(spark, d):
    """Share of urls fetched by content type of the last layer tried."""
    won = fetching.first_success(table(spark, d, "fetch_attempts")).select("url", texts.media_type(F.col("content_type")).alias("media_type"), F.col("layer").isNotNull().alias("won"))
    return won.groupBy("media_type").agg(F.count("*").alias("urls"), F.count_if("won").alias("fetched"))


def layer_share(spark, d):
    """Which layers the cached pages came from, and their share."""
    n = table(spark, d, "content_cache").groupBy("layer_used").agg(F.count("*").alias("pages"))
    return n.withColumn("share", F.round(100.0 * F.col("pages") / F.sum("pages").over(Window.partitionBy()), 4))


def content_quality(spark, d):
    """Noise, tags, encoding and paragraphs of the cached pages by layer."""
    q = fetching.quality(table(spark, d, "content_cache"))
    return q.groupBy("layer_used").agg(
        F.count("*").alias("pages"), F.count_if("title_found").alias("titled"), F.count_if(F.col("noise_found") == "").alias("noiseless"), F.count_if(F.col("tag_count") == 0).alias("tagless"),
        F.count_if("encoding_ok").alias("encoded"), F.floor(F.avg("paragraph_count")).alias("mean_paragraphs"), F.floor(F.avg("content_bytes")).alias("mean_bytes"),
    )


def noise_of_pages(spark, d):
    """Names of the noise patterns of each page."""
    return fetching.quality(table(spark, d, "content_cache")).select("content_id", "noise_found", "tag_count")


def extracted_pages(spark, d):
    """Text of each page without noise lines, as a digest and length."""
    e = fetching.cleaned(table(spark, d, "content_cache"))
    return e.select("content_id", "title", F.md5("text").alias("digest"), F.length("text").alias("chars"), "error")


def extracted_articles(spark, d):
    """Main text of each page by its media type, as a digest and length; of HTML without elements that are no article."""
    e = fetching.extracted(table(spark, d, "content_cache"))
    return e.select("content_id", "title", F.md5("text").alias("digest"), F.length("text").alias("chars"), "error")


def extracted_texts(spark, d):
    """As extracted_articles, of the pages that are no HTML."""
    pages = table(spark, d, "content_cache").where("NOT coalesce(contains(lower(content_type), 'text/html'), false)")
    e = fetching.extracted(pages)
    return e.select("content_id", "title", F.md5("text").alias("digest"), F.length("text").alias("chars"), "error")


def cache_state(spark, d):
    """The cache after all puts: of each url the row put last."""
    return cache.latest(table(spark, d, "content_cache")).select("url", "content_id", "fetched_at", "layer_used", F.octet_length("content").alias("bytes"))


def cache_lookup(spark, d):
    """Distinct urls of hits looked up in the cache at a fixed time: hits and misses by source type."""
    stored = cache.latest(table(spark, d, "content_cache")).select("url", "fetched_at", "ttl_seconds", "layer_used")
    asked = _hits(spark, d).where("url <> ''").select("url", "source_type").distinct()
    found = cache.looked_up(asked, stored, NOW)
    return found.groupBy("source_type").agg(F.count("*").alias("urls"), F.count_if("from_cache").alias("from_cache"))


def cache_ttl(spark, d):
    """Pages by the time they may stay, as the rules give it."""
    pages = table(spark, d, "content_cache").select(cache.ttl_for(F.col("url")).alias("ttl"))
    return pages.groupBy("ttl").agg(F.count("*").alias("pages"))


def cache_evicted(spark, d):
    """The oldest tenth of the cache."""
    stored = cache.latest(table(spark, d, "content_cache")).select("url", "fetched_at")
    return cache.evicted(stored)


def source_prompts(spark, d):
    """The first 25 sources of each run whose url is in the cache as one prompt with content, as a digest."""
    sources = table(spark, d, "json_sources").withColumn("url", F.concat(F.lit("https://"), F.lower(urls.url_domain(F.col("url")))))
    # json_sources names no page of the cache, so the last page put of the same host stands for it
    host = F.concat(F.lit("https://"), F.lower(urls.url_domain(F.col("url"))))
    by_host = cache.latest(table(spark, d, "content_cache").withColumn("url", host)).select("url", "content")
    p = answers.prompts(answers.with_content(sources, by_host))
    return p.select("run_id", "n_sources", F.md5("prompt").alias("digest"))


def merged_citations(spark, d):
    """Citations of each run followed by its fetched sources that aren't cited."""
    rows = table(spark, d, "json_sources").where("url <> ''")
    cited = hits.keep_first(rows.where("id <= 5").select("run_id", "id", "url", "row_id"), F.col("url"), ["id", "row_id"], "run_id")
    fetched = hits.keep_first(rows.where("fetched").select("run_id", "id", "url", "row_id"), F.col("url"), ["id", "row_id"], "run_id")
    return answers.merged_citations(cited, fetched)


def answer_texts(spark, d):
    """Answers as JSON texts, some fenced, some with stray backslashes, some broken, parsed back."""
    q = table(spark, d, "questions").where("question_id IS NOT NULL")
    body = F.concat(F.lit('{"answer": "see C:\\'), F.lit("Work on "), F.col("question_id").cast("string"), F.lit('", "citations": [{"id": 1, "url": "https://a.example/'), F.col("question_id").cast("string"), F.lit('"}], "confidence": "'), F.coalesce("difficulty", F.lit("none")), F.lit('"}'))
    good = F.regexp_replace(body, r"\\", "")
    raw = F.when(F.col("question_id") % 4 == 0, good).when(F.col("question_id") % 4 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(F.col("question_id") % 4 == 2, body).otherwise(F.substring(good, 1, 30))
    read = answers.parsed_answers(q.select("question_id", raw.alias("raw")))
    return read.select("question_id", "answer", F.get("citations", F.lit(0))["url"].alias("first_url"), "confidence", "error")


def _measured(spark, d) -> DataFrame:
    """Scores of the questions: the ground truth is the domains and types of their hits, the answer their best sources."""
    h = _hits(spark, d).where("question_id IS NOT NULL AND domain IS NOT NULL")
    n = h.groupBy("question_id", "domain").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "domain"))).where("k <= 3")
    truth = top.groupBy("question_id").agg(F.array_sort(F.collect_list("domain")).alias("required"))
    s = hits.selected(hits.with_authority(hits.deduplicated(h), AUTHORITY).withColumn("score", F.col("authority")), 3, 10)
    cited = s.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("source_no", urls.url_domain(F.col("url")).alias("d"), "source_type"))).alias("c"))
    asked = table(spark, d, "questions").select("question_id", "query_id", "category", "query")
    both = asked.join(truth, "question_id").join(cited, "question_id")
    domains = F.transform("c", lambda x: x["d"])
    kinds = F.filter(F.transform("c", lambda x: x["source_type"]), lambda x: x.isNotNull())
    metrics = {
        "domain_hit": scoring.domain_hit_rate(F.col("required"), domains), "term_coverage": scoring.term_coverage(F.split(F.col("query"), " "), F.array_join(domains, " ")),
        "pollution": scoring.pollution(F.array(F.lit("invalid")), domains), "diversity": scoring.diversity(F.array(F.lit("general_web"), F.lit("code")), kinds),
        "latency": scoring.share_spared(F.length("query") * 500.0, LATENCY_BUDGET_MS), "cost": scoring.share_spared(F.size("c") * 0.05, 0.5),
    }
    m = both.select("question_id", "category", *(v.alias(k) for k, v in metrics.items()))
    return m.withColumn("composite", scoring.composite({k: F.col(k) for k in metrics}))


def question_scores(spark, d):
    """Metrics and composite of each question."""
    m = _measured(spark, d)
    return m.select("question_id", *(F.round(c, 6).alias(c) for c in (*ANSWER_WEIGHTS, "composite")))


def category_report(spark, d):
    """Composite by category and over all, from a written table of scores."""
    measured = written(_measured(spark, d).withColumn("composite", F.round("composite", 6)), "scores")
    r = scoring.by_category(measured, list(ANSWER_WEIGHTS))
    return r.select("category", "n", *(F.round(c, 4).alias(c) for c in r.columns[2:]))


def extreme_questions(spark, d):
    """The ten worst and the ten best questions, from a written table of scores."""
    return scoring.extremes(written(_measured(spark, d).select("question_id", F.round("composite", 6).alias("composite")), "scores"), "question_id")


def validation_issues(spark, d):
    """Rows of hits that break a rule, by rule."""
    h = _hits(spark, d)
    rules = {
        "no question": F.col("question_id").isNull(), "no title": F.coalesce("title", F.lit("")) == "", "no snippet": F.coalesce("snippet", F.lit("")) == "", "no source type": F.col("source_type").isNull(),
        "loaded late": F.col("loaded_at") > F.col("found_at") + F.expr("INTERVAL 1 DAY"), "domain differs": F.col("domain").isNotNull() & ~scoring.ends_with_domain(F.lower(urls.url_domain(F.col("url"))), F.col("domain")),
    }
    found = h.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def numbered_sources(spark, d):
    """Sources of each run numbered by score, without sorting a run, or equal scores of one, as a whole."""
    rows = table(spark, d, "json_sources").where("score IS NOT NULL").select("run_id", "row_id", "score")
    return ranking.numbered(rows, ["run_id"], F.floor(-F.col("score") * 64), -F.col("score"), "row_id", "place").select("run_id", "row_id", "place")


def hourly_hits(spark, d):
    """Hits of each module by hour of arrival, by the streaming operator over a bounded table."""
    w = cache_stream.hourly_counts(_hits(spark, d))
    return w.select(F.unix_timestamp("start").alias("start"), "module", "hits")


def question_results(spark, d):
    """Hits of one module as question JSON, parsed back."""
    n = F.col("hit_id") % 4
    item = F.struct("title", F.col("url").alias("link"), F.array(F.col("source_type"), F.col("module")).alias("tags"), (F.col("hit_id") % 50).alias("score"), n.alias("answer_count"), F.when(n == 3, F.col("hit_id")).alias("accepted_answer_id"))
    return payloads.questions_json(_payload(_paged(spark, d, "stackask"), item, lambda x: F.to_json(F.struct(x.alias("items")))))


def webpage_results(spark, d):
    item = F.struct("title", F.col("url").alias("link"), "snippet")
    return payloads.pages_json(_payload(_paged(spark, d, "metanook"), item, lambda x: F.to_json(F.struct(x.alias("webpages")))))


def listed_results(spark, d):
    """Hits of one module as an HTML list of results, some with a caption and some with a bare paragraph, parsed back."""
    text = F.concat(F.lit("<p>"), _escaped(F.col("snippet")), F.lit("</p>"))
    caption = F.when(F.col("hit_id") % 2 == 0, F.concat(F.lit('<div class="b_caption">'), text, F.lit("</div>"))).otherwise(text)
    item = F.concat(F.lit('<li class="b_algo"><h2><a href="'), _escaped(F.col("url")), F.lit('">'), _escaped(F.col("title")), F.lit("</a></h2>"), caption, F.lit("</li>"))
    made = _payload(_paged(spark, d, "webscout"), item, lambda x: F.concat(F.lit('<ol id="b_results"><li class="b_ad"><h2><a href="https://ad.example/">Ad</a></h2></li>'), F.array_join(x, "\n"), F.lit("</ol>")))
    return payloads.listed_page(made).select("task_id", "title", "url", "snippet")


def container_results(spark, d):
    """Hits of one module as an HTML page of containers with the real url as an attribute, some pages asking for verification, parsed back."""
    part = F.when(F.col("hit_id") % 3 == 0, F.lit('<div data-module="abstract">')).when(F.col("hit_id") % 3 == 1, F.lit('<div class="cu-line-clamp-2">')).otherwise(F.lit('<div class="c-abstract">'))
    mu = F.when(F.col("hit_id") % 2 == 0, F.concat(F.lit(' mu="'), _escaped(F.col("url")), F.lit('"'))).otherwise(F.lit(""))
    item = F.concat(
        F.lit('<div class="result c-container"'), mu, F.lit('><h3 class="t"><a href="'), _escaped(F.col("url")), F.lit('">'), _escaped(F.col("title")), F.lit("</a></h3>"), part, _escaped(F.col("snippet")), F.lit("</div></div>")
    )
    extra = '<div class="result-op c-container" tpl="recommend_list"><h3><a href="https://ad.example/">More</a></h3></div>'
    rows = _paged(spark, d, "hanseek")
    check = F.when(F.col("question_id") % 7 == 0, F.lit("<p>百度安全验证</p>")).otherwise(F.lit(""))
    made = _payload(rows, F.concat(check, item), lambda x: F.concat(F.lit(extra), F.array_join(x, "\n")))
    return payloads.container_page(made).select("task_id", "title", "url", "snippet")


def collected_hits(spark, d):
    """Answers of the JSON modules parsed and put together with their provenance: hits and tasks of each module."""
    parsed = {"bravura": web_results(spark, d), "serpline": organic_results(spark, d), "metanook": webpage_results(spark, d), "exalt": highlight_results(spark, d)}
    found = hits.well_formed(hits.collected(parsed, hits.enabled(table(spark, d, "module_manifests"), None)))
    return found.groupBy("module", "source_type").agg(F.count("*").alias("hits"), F.count_distinct("task_id").alias("tasks"))


def enabled_tasks(spark, d):
    """Tasks of plans where only some modules are switched on."""
    modules = hits.enabled(table(spark, d, "module_manifests"), ["bravura", "paperfind", "stackask"])
    read = _plans(spark, d).select("question_id", answers.parsed_plan(F.col("raw"))["queries"].alias("queries"))
    return hits.search_tasks(read, modules).groupBy("name", "source_type").agg(F.count("*").alias("tasks"))


def payload_errors(spark, d):
    """Answers of modules by the class of their error: hits stand for answers, statuses and bodies follow their ids."""
    k = F.col("hit_id") % 8
    status = F.when(k == 0, 403).when(k == 1, 429).when(k == 2, 404).when(k == 3, 503).when(k == 4, 418).otherwise(200)
    body = F.when(k == 5, F.lit('{"error": "out of credit"}')).when(k == 6, F.lit('{"error_id": 502}')).otherwise(F.to_json(F.struct("title")))
    return _hits(spark, d).groupBy("module", payloads.payload_error(body, status).alias("error")).agg(F.count("*").alias("answers"))


def _odd_plans(spark, d) -> DataFrame:
    """Plans under other keys than those asked for: a bare list, other names of types, wrapped, broken, empty."""
    q = F.coalesce("query", F.lit(""))
    k = F.col("question_id") % 7
    text = F.to_json(F.array(q, F.concat(q, F.lit(" guide"))))
    raw = (
        F.when(k == 0, F.concat(F.lit('{"queries": '), text, F.lit("}"))).when(k == 1, F.concat(F.lit('{"papers": '), text, F.lit(', "forum": '), text, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"plan": {"rationale": "r", "queries_by_source_type": {"code": '), text, F.lit("}}}"))).when(k == 3, F.concat(F.lit('{"search": {"official-docs": '), text, F.lit("}}")))
        .when(k == 4, F.substring(text, 1, 9)).when(k == 5, F.lit('{"queries_by_source_type": {"code": []}}')).otherwise(F.lit('{"note": 3}'))
    )
    return table(spark, d, "questions").where("question_id IS NOT NULL").select("question_id", raw.alias("raw"))


def recovered_plans(spark, d):
    """Queries of plans in other forms, by source type, and the errors of the others."""
    p = _odd_plans(spark, d).select("question_id", answers.parsed_plan(F.col("raw")).alias("p"))
    kinds = F.array_join(F.array_sort(F.map_keys("p.queries")), ",")
    n = F.aggregate(F.map_values("p.queries"), F.lit(0), lambda acc, v: acc + F.size(v))
    return p.select("question_id", kinds.alias("kinds"), n.alias("n"), "p.error")


def plan_checks(spark, d):
    """What plans lack of the keys asked for, and what they have besides."""
    p = _odd_plans(spark, d).where("question_id % 7 IN (0, 3, 5, 6)").select("question_id", F.explode(answers.plan_issues(F.col("raw"))).alias("issue"))
    return p.groupBy("issue").agg(F.count("*").alias("plans"))


def retried_plans(spark, d):
    """Recorded responses of up to four attempts a question: the attempt that gave a plan, and the tokens up to it."""
    q = _odd_plans(spark, d).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(4))))
    good = F.lit('{"code": ["x"]}')
    content = F.when(F.col("attempt") > F.col("question_id") % 5, good).otherwise(F.lit("sorry"))
    usage = F.struct((F.col("question_id") % 100).alias("prompt_tokens"), F.col("attempt").cast("long").alias("completion_tokens"), F.struct(F.lit(7).cast("long").alias("cached_tokens")).alias("prompt_tokens_details"))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"), usage.alias("usage")))
    t = answers.attempted_plans(q.select("question_id", "attempt", F.when((F.col("question_id") % 11 == 0) & (F.col("attempt") == 1), F.lit('{"choices": []}')).otherwise(response).alias("response")))
    return t.select("question_id", "attempt", F.size(F.map_keys("queries")).alias("kinds"), "error", "input_tokens", "output_tokens", "cached_tokens")


def plan_sizes(spark, d):
    """Queries and source types of each plan that has any."""
    p = _plans(spark, d).select("question_id", answers.parsed_plan(F.col("raw"))["queries"].alias("q"))
    asked = F.filter(F.map_values("q"), lambda v: F.size(F.filter(v, lambda x: x != "")) > 0)
    return p.select("question_id", F.aggregate(asked, F.lit(0), lambda acc, v: acc + F.size(v)).alias("queries"), F.size(asked).alias("kinds"))


def fetched_counts(spark, d):
    """Sources of each run, how many were fetched and their percentage."""
    n = table(spark, d, "json_sources").groupBy("run_id").agg(F.count("*").alias("sources"), F.count_if("fetched").alias("fetched"))
    return n.withColumn("rate", F.round(texts.percent(F.col("fetched"), F.col("sources")), 1))


def _won(spark, d) -> DataFrame:
    return fetching.first_success(table(spark, d, "fetch_attempts")).withColumn("won", F.col("layer").isNotNull())


def success_by_difficulty(spark, d):
    """Share of urls fetched and their mean latency by difficulty, which follows the length of the url here."""
    level = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.length("url") % 3 + 1).cast("int"))
    return fetching.success_report(_won(spark, d).withColumn("difficulty", level), "difficulty")


def success_by_layer(spark, d):
    """Layers that won, and their share of all successes."""
    n = _won(spark, d).where("won").groupBy("layer").agg(F.count("*").alias("urls"))
    return n.withColumn("share", F.round(texts.percent(F.col("urls"), F.sum("urls").over(Window.partitionBy())), 1))  # a row for each layer


def attempt_errors(spark, d):
    """Failed attempts by the class of what went wrong; statuses, flags and lengths follow their ids."""
    a, k = table(spark, d, "fetch_attempts").where("NOT ok"), F.col("attempt_id") % 10
    status = F.when(k == 0, 401).when(k == 1, 410).when(k == 2, 500).when(k == 3, 204).otherwise(422)
    whole = fetching.body_complete(F.when(k < 3, F.lit("gzip")).otherwise(F.lit("identity")), k % 2 == 0, k * 100, F.when(k == 4, -1).otherwise(500), F.lit(700))
    return a.groupBy(
        fetching.status_error(status).alias("by_status"), fetching.transport_error(F.col("err_kind") == "timeout", k == 7).alias("by_transport"), whole.alias("whole")
    ).agg(F.count("*").alias("attempts"))


def url_forms(spark, d):
    """Where redirects of hits' urls lead, and archived pages without the archive's frame."""
    k, u = F.col("hit_id") % 5, F.col("url")
    location = F.when(k == 0, F.lit("/next?x=1")).when(k == 1, F.lit("//other.test/a")).when(k == 2, F.lit("https://third.test/")).when(k == 3, F.lit("page2"))
    snapshot = urls.raw_snapshot_url(F.concat(F.lit("https://archive.test/web/2020"), F.when(k > 2, "id_").otherwise(""), F.lit("/"), u))
    return _hits(spark, d).select("hit_id", urls.redirected(u, location).alias("target"), snapshot.alias("snapshot"))


def short_titles(spark, d):
    """Titles of hits as report cells of at most 40 characters."""
    return _hits(spark, d).select("hit_id", texts.table_cell(texts.shortened(F.col("title"), 40)).alias("cell"))


def latency_texts(spark, d):
    """Latencies of attempts as reports write them."""
    return table(spark, d, "fetch_attempts").select("attempt_id", texts.milliseconds(F.col("latency_ms") * (F.col("attempt_id") % 40)).alias("took"))


def hit_previews(spark, d):
    """The first three hits of each question."""
    return hits.previews(_hits(spark, d)).select("question_id", "hit_id", "n")


def repeated_titles(spark, d):
    """Hits whose title an earlier hit of their question has, and which that is."""
    return hits.previous(_hits(spark, d).where("title <> ''"), F.lower(F.trim("title")), ["pos", "hit_id"], ["question_id"]).select("hit_id", F.col("first.hit_id").alias("first_hit"))


def top_citations(spark, d):
    """The first five sources of each question in a run by rank; ranks that are not positive are last, as they came."""
    rank = F.when(F.col("row_id") % 6 == 0, F.lit(0)).otherwise(F.col("id"))
    listed = table(spark, d, "json_sources").where("question_id IS NOT NULL").groupBy("run_id", "question_id").agg(F.collect_list(F.struct(rank.cast("long").alias("rank"), F.col("row_id").alias("pos"), "url")).alias("c"))
    return listed.select("run_id", "question_id", F.posexplode(scoring.top_by_rank(F.col("c"), 5)).alias("n", "s")).select("run_id", "question_id", "n", F.col("s.pos").alias("row_id"))


def cache_flow(spark, d):
    """Urls asked of the cache first and fetched after: where each content came from, and what is put."""
    pages = table(spark, d, "content_cache")
    stored = cache.latest(pages).where("content_id % 2 = 0")
    fetched = cache.latest(pages).where("content_id % 3 <> 0").select("url", "content", "content_type", "layer_used")
    results, puts = cache.coalesced(pages.where("url IS NOT NULL").select("url").distinct(), stored, fetched, NOW)
    put = puts.select(F.col("url").alias("_p"), "ttl_seconds")
    joined = results.join(put, F.col("url") == F.col("_p"), "left")
    return joined.groupBy("from_cache", "layer_used", "ttl_seconds").agg(F.count("*").alias("urls"))


def cache_full(spark, d):
    """What goes from the cache when its bytes exceed the most it may hold."""
    return cache.evicted_if_full(cache.latest(table(spark, d, "content_cache")), CACHE_BYTES).select("url", "fetched_at")


def set_issues(spark, d):
    """Rules of a query set that questions break, their ground truth being made of their hits' domains and their words."""
    n = _hits(spark, d).where("question_id IS NOT NULL AND domain IS NOT NULL").groupBy("question_id").agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.array_sort(F.collect_set("source_type")).alias("kinds"))
    q = table(spark, d, "questions").join(n, "question_id", "left")
    k = F.col("question_id") % 9
    rows = q.select(
        F.when(k == 0, F.lit("same")).otherwise(F.col("query_id")).alias("query_id"), F.col("question_id").alias("pos"), "category", F.when(k == 1, F.lit("comparison")).otherwise(F.col("category")).alias("type"), "query", F.col("lang").alias("intent"),
        "difficulty", "tech_area", F.when(k != 2, F.col("query")).alias("canonical_answer"), F.slice("domains", 1, 5).alias("must_contain_domains"), F.slice(F.split("query", " "), 1, 5).alias("must_contain_terms"),
        F.when(k == 3, F.array(F.lit("a.test"), F.lit(" A.test "))).otherwise(F.array().cast("array<string>")).alias("forbidden_domains"), F.when(k != 4, F.col("kinds")).alias("expected_source_types"),
    )
    return scoring.set_issues(rows).groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"))


def conversation_texts(spark, d):
    """Messages of each question and its first hits as one JSON array, as a digest."""
    asked = table(spark, d, "questions").select("question_id", F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("query").alias("content"))
    said = hits.previews(_hits(spark, d)).where("question_id IS NOT NULL").select("question_id", F.col("n").cast("long").alias("turn"), F.lit("tool").alias("role"), F.col("url").alias("content"))
    return answers.conversations(asked.unionByName(said)).select("question_id", F.get_json_object("messages", "$[0].content").alias("first"), F.json_array_length("messages").alias("messages"))


def result_texts(spark, d):
    """Results of runs as JSON without empty fields, and what they hold."""
    n = table(spark, d, "json_sources").groupBy("run_id").agg(F.count_if("fetched").alias("fetched"), F.max("title").alias("title"))
    answer = F.when(F.col("run_id") % 3 == 0, F.col("title")).otherwise(F.lit(""))
    fields = {"run_id": F.col("run_id"), "fetched": F.when(F.col("run_id") % 2 == 0, F.col("fetched")).otherwise(F.lit(0)), "note": F.lit("")}
    return n.select("run_id", answers.result_mode(answer, F.col("fetched")).alias("mode"), answers.result_json(fields).alias("result"))


def report_rows(spark, d):
    """Failed questions by category in the order of reports: those without a hit."""
    asked = table(spark, d, "questions").select("question_id", "query_id", "category")
    results = asked.join(_hits(spark, d).select("question_id").distinct().withColumn("hit", F.lit(True)), "question_id", "left").select("query_id", "category", F.when(F.col("hit").isNull(), "no hits").alias("error"))
    return scoring.failures(results).select("query_id", "error", scoring.category_place(F.col("category")).alias("place"))


def variant_results(spark, d):
    """Sources, fetched ones and prompts of the variants of the whole path; the last page of a url's host stands for its page."""
    host = lambda u: F.lower(urls.url_domain(u))
    pages = cache.latest(table(spark, d, "content_cache").withColumn("url", host(F.col("url")))).select("url", "content")
    found, asked = _hits(spark, d), pipeline.blind(table(spark, d, "questions"))
    by_variant = {"baseline": pipeline.baseline(found), "selected": pipeline.selected_sources(asked, found, AUTHORITY)}
    out = [pipeline.results(df.withColumn("url", host(F.col("url"))), pages, name) for name, df in by_variant.items()]
    return out[0].unionByName(out[1]).select("question_id", "variant", "sources", "fetched", F.col("prompt").isNotNull().alias("prompted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        url_keys, deduplicated_hits, scored_hits, select_sources, planned_tasks, web_results, organic_results, highlight_results, repository_results, feed_results, page_results, fetch_chain,
        layer_report, success_by_type, layer_share, content_quality, noise_of_pages, extracted_pages, cache_state, cache_lookup, cache_ttl, cache_evicted, source_prompts, merged_citations,
        answer_texts, question_scores, category_report, extreme_questions, validation_issues, numbered_sources, hourly_hits,
        question_results, webpage_results, listed_results, container_results, collected_hits, enabled_tasks, payload_errors, recovered_plans, plan_checks, retried_plans, plan_sizes, fetched_counts,
        success_by_difficulty, success_by_layer, attempt_errors, url_forms, short_titles, latency_texts, hit_previews, repeated_titles, top_citations, cache_flow, cache_full, set_issues,
        conversation_texts, result_texts, report_rows, extracted_articles, extracted_texts, variant_results,
    )
    return {f.__name__: f for f in listed}
