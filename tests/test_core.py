"""Core operators on small rows with nulls, ties, repeats, empty tables and clashing columns."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanwork.functions import texts, urls
from gleanwork.operators import answers, cache, fetching, hits, ranking, scoring
from gleanwork.plans import oracle, queries
from gleanwork.sources import payloads, recorded

HIT = "hit_id long, question_id long, pos long, title string, url string, snippet string, source_type string, module string"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "url, key",
    [
        ("HTTPS://Shop.Test/Cart/", "https://shop.test/Cart"), ("https://www.shop.test/cart#top", "https://shop.test/cart"), ("https://shop.test", "https://shop.test"), ("https://shop.test/", "https://shop.test/"),
        ("https://shop.test/c?z=9&b=1&gclid=q", "https://shop.test/c?b=1&z=9"), ("https://shop.test/c?FBCLID=q", "https://shop.test/c"), ("https://shop.test/c?flag", "https://shop.test/c?flag="),
        ("https://shop.test/C?k=b&k=a", "https://shop.test/C?k=b&k=a"), ("http://shop.test:80/c", "http://shop.test:80/c"), ("/Only/Path/", "/Only/Path"), ("", ""), (None, None),
        ("https://shop.test/c?q=red%20tea", "https://shop.test/c?q=red+tea"), ("https://shop.test/c?q=red+tea", "https://shop.test/c?q=red+tea"), ("https://shop.test//", "https://shop.test"), ("https://shop.test/c?", "https://shop.test/c?"),
        ("https://shop.test/c?q=caf%C3%A9&r=%zz", "https://shop.test/c?q=caf%C3%A9"), ("https://shop.test/%zz/A/", "https://shop.test/%zz/a"), ("//Shop.test/c/", "//shop.test/c"),
    ],
)
def test_url_key(spark, url, key):
    assert one(spark, urls.url_key, url) == key


def test_domain_endings(spark):
    df = spark.createDataFrame([("a.b.c", "b.c"), ("notb.c", "b.c"), ("b.c.evil", "b.c"), ("", "b.c"), ("B.C", "b.c")], "d string, p string")
    assert [r[0] for r in df.select(urls.ends_with_domain(F.col("d"), F.col("p"))).collect()] == [True, False, False, False, True]
    assert one(spark, urls.domain_suffixes, "a.b.c") == ["a.b.c", "b.c", "c"]
    assert one(spark, urls.unwrap_redirect, "//go.x/l/?uddg=https%3A%2F%2Fa.b%2Fc&z=1") == "https://a.b/c"
    assert one(spark, urls.raw_snapshot_url, "https://w.org/web/2020/http://a.b/") == "https://w.org/web/2020id_/http://a.b/"


def test_texts(spark):
    assert one(spark, texts.tokens, "Which tea is the best for a cold, if any?") == ["tea", "best", "cold", "any"]
    assert one(spark, texts.collapse_newlines, "a\n\n\nb") == "a\nb"
    assert one(spark, texts.markdown_title, "x\n# Title here\ny") == "Title here"
    assert one(spark, texts.unfenced, "<think>a</think>\n```json\n{}\n```") == "{}"
    assert one(spark, texts.media_type, "Text/HTML; charset=utf-8") == "text/html"
    assert one(spark, texts.drop_noise, "Share this page\nWords\n\nHome > Docs > API\n© 2020 Acme") == "Words\n"
    kept = "Browsers keep each cookie in a jar until it expires.\nNext we look at sessions."
    assert one(spark, texts.drop_noise, kept) == kept
    assert one(spark, lambda c: texts.shortened(c, 10), "one  two three four") == "one two..." and one(spark, texts.table_cell, "a|b\nc") == "a\\|b c"
    took = spark.createDataFrame([(-1,), (850,), (12_340,), (125_000,), (None,)], "ms long").select(texts.milliseconds(F.col("ms")))
    assert [r[0] for r in took.collect()] == ["-", "850ms", "12.3s", "2m05s", "-"]
    assert one(spark, lambda c: texts.cut_to(c, 10), "aaaa bbbb cccc") == "aaaa bbbb\n[content truncated]"


def test_dedup_keeps_first_and_null_groups(spark):
    rows = [(2, 1, 2, "t", "https://a.com/p/", "s", "web", "m"), (1, 1, 1, None, "https://www.a.com/p", None, None, "m"), (3, None, 1, "t", "https://a.com/p", "s", "web", "m"), (4, None, 1, "t", "https://a.com/p#x", "s", "web", "m")]
    got = hits.deduplicated(spark.createDataFrame(rows, HIT)).orderBy("hit_id").collect()
    assert [(r.hit_id, r.url) for r in got] == [(1, "https://www.a.com/p"), (3, "https://a.com/p")]
    assert hits.deduplicated(spark.createDataFrame([], HIT)).count() == 0
    late = [(7, 1, None, "t", "https://shop.test/c", "s", "web", "m"), (8, 1, 5, "t", "https://shop.test/c", "s", "web", "m"), (9, 2, None, "t", "https://shop.test/c", "s", "web", "m")]
    assert {r.hit_id for r in hits.deduplicated(spark.createDataFrame(late, HIT)).collect()} == {8, 9}
    again = [r.asDict() for r in hits.previous(spark.createDataFrame(rows, HIT), F.lower("title"), ["hit_id"]).collect()]
    assert [(r["hit_id"], r["first"]["hit_id"]) for r in sorted(again, key=lambda r: r["hit_id"])] == [(3, 2), (4, 2)]


def test_selection_balances_types(spark):
    rows = [(i, 1, i, t, s) for i, (t, s) in enumerate([("shop", 0.31), ("shop", 0.77), ("shop", 0.52), ("maps", 0.44), ("mail", 0.12), ("shop", 0.52)])]
    df = spark.createDataFrame(rows, "hit_id long, question_id long, pos long, source_type string, score double")
    assert [r.hit_id for r in hits.selected(df, 1, 4).orderBy("source_no").collect()] == [1, 2, 3, 4]
    assert hits.selected(df, 10, 3).count() == 3


def test_authority(spark):
    df = spark.createDataFrame([("https://x.go.dev/a",), ("https://docs.some.io/",), ("https://other.io/",), ("https://go.dev:443/",), (None,)], "url string")
    got = {r.url: r.authority for r in hits.with_authority(df, {"go.dev": 1.0, "dev": 0.1}).collect()}
    assert {r.authority for r in hits.with_authority(df, {}).collect()} == {0.5, 0.85}
    assert got == {"https://x.go.dev/a": 1.0, "https://docs.some.io/": 0.85, "https://other.io/": 0.5, "https://go.dev:443/": 0.5, None: 0.5}


def test_numbering_over_buckets(spark):
    rows = [(k, i % 7, i) for k in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v long, id long")
    got = ranking.numbered(df, ["k"], F.floor(F.col("v") / 2), F.col("v"), "id").collect()
    for key in ("a", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, 61))
        assert [(r.v, r.id) for r in mine] == sorted((r.v, r.id) for r in mine)


def test_numbering_of_equal_values(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 16)
    df = spark.createDataFrame([("a", 1.0, i) for i in range(500)] + [("a", 0.5, 500 + i) for i in range(30)], "k string, v double, id long")
    got = {r.id: r.n for r in ranking.numbered(df, ["k"], F.floor(F.col("v")), F.col("v"), "id").collect()}
    assert got == {**{500 + i: 1 + i for i in range(30)}, **{i: 31 + i for i in range(500)}}


def test_percentiles_equal_sorting(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 3}", None if i % 17 == 0 else (i * 7919 % 1000) / 9) for i in range(900)]
    got = {r.k: (r.p50, r.p95, r.p0) for r in ranking.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0}).collect()}
    for key in {k for k, _ in rows}:
        mine = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key] == tuple(mine[max(-(-int(len(mine) * s * 100) // 100), 1) - 1] if s else mine[0] for s in (0.5, 0.95, 0.0))
    assert ranking.percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"p50": 0.5}).count() == 0


def test_eviction_takes_the_oldest(spark):
    df = spark.createDataFrame([(f"u{i}", i * 1000 // 3) for i in range(45)], "url string, fetched_at long")
    assert sorted(r.url for r in cache.evicted(df).collect()) == ["u0", "u1", "u2", "u3"]
    assert cache.evicted(df.limit(0)).count() == 0
    assert cache.evicted(df.where("url = 'u7'")).count() == 1


def test_cache_lookup_and_upsert(spark):
    c = "url string, fetched_at long, content_id long, ttl_seconds long, layer_used string"
    old = spark.createDataFrame([("a", 10, 1, 5, "x"), ("b", 10, 2, 50, "y")], c)
    new = spark.createDataFrame([("a", 20, 3, 100, "z")], c)
    state = cache.upserted(old, new)
    assert {(r.url, r.content_id) for r in state.collect()} == {("a", 3), ("b", 2)}
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "url string")
    assert {(r.url, r.from_cache) for r in cache.looked_up(asked, state, 60).collect()} == {("a", True), ("b", False), ("c", False), (None, False)}
    assert one(spark, lambda u: cache.ttl_for(u, [("/docs/", 7), ("blog.", 1)]), "https://blog.a.com/docs/x") == 7


def test_first_success(spark):
    rows = [(1, "u", "a", 1, True, False, "timeout", None, 5), (2, "u", "b", 2, True, True, None, "text/html", 6), (3, "u", "c", 3, True, False, "late", None, 1), (4, "v", "a", 1, False, True, None, None, 1), (5, "v", "b", 2, True, False, None, None, -1)]
    df = spark.createDataFrame(rows, "attempt_id long, url string, layer string, layer_order int, enabled boolean, ok boolean, err_kind string, content_type string, latency_ms long")
    got = {r.url: (r.layer, r.errors) for r in fetching.first_success(df).collect()}
    assert got == {"u": ("b", "a:timeout"), "v": (None, "b:unknown")}
    assert {r.layer: r.mean_ms for r in fetching.layer_report(df).collect()} == {"a": 5, "b": 6, "c": 1}


def test_answers(spark):
    raw = ['```json\n{"answer": "x", "confidence": "high"}\n```', r'{"answer": "C:\Users", "citations": [{"id": 1, "url": "u"}]}', "no json", '{"answer": " "}', None]
    got = answers.parsed_answers(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")).orderBy("i").collect()
    assert [(r.answer, r.confidence, r.error) for r in got] == [("x", "high", None), (r"C:\Users", "medium", None), (None, "medium", "invalid answer JSON"), (" ", "medium", "empty answer"), (None, "medium", "invalid answer JSON")]
    plans = ['{"queries_by_source_type": {"code": ["a", ""]}}', '{"code": ["b"]}', "{", '{"code": []}', None]
    errors = [spark.createDataFrame([(p,)], "raw string").select(answers.parsed_plan(F.col("raw")).alias("p")).first().p.error for p in plans]
    assert errors == [None, None, "invalid plan JSON", "zero queries", "invalid plan JSON"]
    forms = {'["a", 3, "b"]': {"general_web": ["a", "b"]}, '{"x": {"y": {"Papers": ["p"]}}, "web": ["w"], "search": ["s"]}': {"general_web": ["s", "w"], "academic": ["p"]}, '{"plan": {"queries_by_source_type": {"docs": ["d"]}}}': {"docs": ["d"]}}
    for raw, want in forms.items():
        got = spark.createDataFrame([(raw,)], "raw string").select(answers.parsed_plan(F.col("raw")).alias("p")).first().p
        assert {k: sorted(v) for k, v in got.queries.items()} == want and got.error is None
    mended = {r'{"a": "C:\dir \w \n \u00e9 \\ ok"}': r'{"a": "C:\\dir \\w \n \u00e9 \\ ok"}', '{"a": 1, \\ "b": "x"}': '{"a": 1,  "b": "x"}', '{"a": "x"}': '{"a": "x"}'}
    for raw, want in mended.items():
        assert one(spark, answers.mended, raw) == want


def test_articles():
    from gleanwork.operators.articles import main_text

    page = """<html><head><title>Own  title</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-bar">We use cookies</div>
    <div id="content"><h1>Head</h1><p>First long paragraph, with a <a href="/x">link</a> in it.</p><ul><li><a href="/1">One</a></li></ul><p>Second &amp; last.<p>Third <br>line</div>
    <div role="complementary">Side</div><footer>Foot</footer><script>x()</script></body></html>"""
    assert main_text(page) == ("Head\nFirst long paragraph, with a link in it.\nSecond & last.\nThird\nline", "Own title")
    assert main_text("") == ("", "") and main_text("just text") == ("just text", "") and main_text("<p>open <b>bold") == ("open bold", "")
    assert main_text("<div>" * 5000 + "deep")[0] == "deep"


def test_extraction_by_type(spark):
    rows = [(1, None, "<p>Word one.</p><nav>x</nav>", "text/html; charset=utf-8"), (2, "kept", " # T \n\n\nbody  \n", "TEXT/markdown"), (3, None, "<p>raw</p>", None), (4, None, None, "text/html"), (5, "t", "  \n ", "text/plain"), (6, None, " # T\nwords here", "text/markdown")]
    df = spark.createDataFrame(rows, "content_id long, title string, content string, content_type string")
    got = {r.content_id: (r.title, r.text, r.error) for r in fetching.extracted(df, 1).collect()}
    assert got == {1: (None, "Word one.", None), 2: ("kept", "# T\nbody", None), 3: (None, "<p>raw</p>", None), 4: (None, None, "empty"), 5: ("t", None, "empty"), 6: ("T", "# T\nwords here", None)}
    assert [r.error for r in fetching.extracted(df, 10).where("content_id = 3 OR content_id = 1").collect()] == ["too short", None]


def test_prompts_hold_fetched_content(spark):
    rows = [(1, 2, "web", 0.456, "u2", None, "b" * 9000, 2), (1, 1, "web", None, "u1", "T", "short", 1), (1, 3, None, 1.0, "u3", "T", None, 3)]
    df = spark.createDataFrame(rows, "run_id long, id long, source_type string, score double, url string, title string, content string, row_id long")
    r = answers.prompts(df).first()
    assert r.n_sources == 2 and r.prompt.startswith("SOURCE 1 [web / score 0.00]\nURL: u1\nTitle: T\nContent:\nshort\n\nSOURCE 2 [web / score 0.46]\n") and r.prompt.endswith("b" * 8000 + "\n[content truncated]\n\n")


def test_scores(spark):
    df = spark.createDataFrame([(["a.com"], ["x.a.com", "b.com"], [], "")], "req array<string>, doms array<string>, none array<string>, txt string")
    r = df.select(
        scoring.domain_hit_rate(F.col("req"), F.col("doms")), scoring.domain_hit_rate(F.col("none"), F.col("doms")), scoring.pollution(F.array(F.lit("b.com")), F.col("doms")),
        scoring.term_coverage(F.array(F.lit("t")), F.col("txt")), scoring.share_spared(F.lit(15.0), 150.0), scoring.diversity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))),
    ).first()
    assert list(r) == [1.0, 1.0, 0.5, 0.0, 0.9, 0.5]


def test_payloads_survive_rubbish(spark):
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, '{"error": "quota"}'), (5, "<feed>")], "task_id long, payload string")
    for parser in (payloads.web_json, payloads.organic_json, payloads.pages_json, payloads.highlights_json, payloads.repositories_json, payloads.questions_json, payloads.result_page, payloads.listed_page, payloads.container_page):
        assert parser(bad).count() == 0
    feed = '<feed><entry><title>T  x</title><summary>S</summary><author><name>A</name></author><author><name>B</name></author><author><name>C</name></author><author><name>D</name></author><link rel="self" href="s"/><link rel="alternate" href="u"/></entry></feed>'
    got = payloads.feed_xml(spark.createDataFrame([(1, feed)], "task_id long, payload string")).first()
    assert (got.title, got.url, got.snippet) == ("T x", "u", "A, B, C et al. — S")
    q = '{"items": [{"title": "t", "link": "l", "tags": ["a","b","c","d","e"], "score": 3, "answer_count": 2, "accepted_answer_id": 9}, {"title": "", "link": "l"}]}'
    got = payloads.questions_json(spark.createDataFrame([(1, q)], "task_id long, payload string")).collect()
    assert [r.snippet for r in got] == ["a, b, c, d | Score: 3 | 2 answers (accepted)"]


def test_recorded_source(spark, tmp_path):
    (tmp_path / "t1.json").write_text('{"webpages": [{"title": "t", "link": "l", "snippet": "s"}]}')
    got = payloads.pages_json(recorded.recorded_answers(spark, str(tmp_path))).collect()
    assert [(r.task_id, r.title) for r in got] == [("t1", "t")]


def test_stream_keeps_the_last_put(spark, tmp_path):
    from gleanwork.streaming import cache_stream

    c = "url string, fetched_at long, content_id long, layer_used string"
    for i, rows in enumerate(([("a", 1, 1, "x"), ("a", 3, 2, "y")], [("a", 2, 3, "z"), ("b", 1, 4, "x")])):
        spark.createDataFrame(rows, c).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    puts = spark.readStream.schema(c).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cache_stream.upsert_stream(puts, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.url, r.content_id) for r in cache_stream.read_cache(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 4)}
    assert cache_stream.compacted(spark, str(tmp_path / "out"), str(tmp_path / "new")) == 2
    assert {(r.url, r.content_id) for r in cache_stream.read_cache(spark, str(tmp_path / "new")).collect()} == {("a", 2), ("b", 4)}


def test_streams_drop_repeats_and_count_by_hour(spark, tmp_path):
    from gleanwork.streaming import cache_stream

    rows = [(1, 1, "u", "m", "2024-01-01 10:00:00"), (2, 1, "u", "m", "2024-01-01 10:00:00"), (3, 1, "v", "m", "2024-01-01 10:59:00"), (4, 1, "v", "n", "2024-01-01 11:00:00")]
    made = spark.createDataFrame(rows, "hit_id long, question_id long, url string, module string, t string").withColumn("found_at", F.to_timestamp("t")).drop("t")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("first", cache_stream.first_deliveries(stream), "append"), ("hours", cache_stream.hourly_counts(stream), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {(r.url, r.module) for r in spark.table("first").collect()} == {("u", "m"), ("v", "m"), ("v", "n")} and spark.table("first").count() == 3
    assert sorted((r.start.hour, r.module, r.hits) for r in spark.table("hours").collect()) == [(10, "m", 3), (11, "n", 1)]


def test_written_tables_are_cleared(spark):
    from gleanwork import session

    df = session.written(spark.range(5).toDF("id"), "t")
    assert df.count() == 5 and session.clear_written(spark) >= 1 and session.clear_written(spark) == 0


def test_reports(spark):
    from gleanwork.sinks import reports

    categories = spark.createDataFrame([("b", 2, 50.04, 1.0, 2.0), (None, 3, 40.0, 1.0, 2.0), ("a|x", 1, None, 1.0, 2.0)], "category string, n long, mean double, p50 double, p95 double")
    worst = spark.createDataFrame([("best", 2, 90.0), ("worst", 1, 10.0)], "side string, id long, composite double")
    text = reports.quality_report("T", categories, worst, "id")
    assert text.index("| a\\|x | 1 | - | 1.0 | 2.0 |") < text.index("| b | 2 | 50.0 |") < text.index("| - | 3 | 40.0 |") < text.index("| worst | 1 | 10.0 |") < text.index("| best | 2 | 90.0 |")


def test_fetch_report(spark, tiny):
    from gleanwork.sinks import reports

    text = reports.fetch_report("F", *(queries.queries()[q](spark, tiny) for q in ("success_by_difficulty", "success_by_type", "success_by_layer")))
    assert text.index("| easy |") < text.index("| medium |") < text.index("| hard |") and "## Layers of successful fetches" in text
    failed = spark.createDataFrame([("q2", "c", "late"), ("q1", "c", "a|b")], "query_id string, category string, error string")
    assert reports.failure_list(failed) == "## Failures\n\n- q1: a\\|b\n- q2: late" and reports.failure_list(failed.limit(0)).endswith("none")


def test_cache_flow_and_size(spark):
    c = "url string, content string, content_type string, layer_used string, fetched_at long, ttl_seconds long"
    stored = spark.createDataFrame([("a", "old", "t", "x", 100, 50), ("b", "dead", "t", "x", 10, 5)], c)
    fetched = spark.createDataFrame([("a", "new", "t", "y"), ("b", "fresh", "t", "y"), ("c", None, None, None)], "url string, content string, content_type string, layer_used string")
    results, puts = cache.coalesced(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string"), stored, fetched, 120)
    assert {(r.url, r.content, r.from_cache) for r in results.collect()} == {("a", "old", True), ("b", "fresh", False), ("c", None, False), ("d", None, False)}
    assert [(r.url, r.fetched_at, r.ttl_seconds) for r in puts.collect()] == [("b", 120, cache.DEFAULT_TTL)]
    assert cache.evicted_if_full(stored, 8).count() == 1 and cache.evicted_if_full(stored, 9).count() == 0 and cache.evicted_if_full(stored.limit(0), 0).count() == 0


def test_set_rules(spark):
    s = "query_id string, pos long, category string, type string, query string, intent string, difficulty string, tech_area string, canonical_answer string, must_contain_domains array<string>, must_contain_terms array<string>, forbidden_domains array<string>, expected_source_types array<string>"
    good = ("q1", 1, "comparison", "comparison", "q", "i", "easy", "t", "a", ["a.test", "b.test"], ["x", "y"], [], ["docs"])
    bad = ("q1", 2, "other", "x", None, "", "odd", None, "a", ["a.test", " A.test", ""], ["x"], ["b"] * 5, ["docs", "docs", "tv"])
    got = sorted((r.query_id, r.issue) for r in scoring.set_issues(spark.createDataFrame([good, bad], s)).collect())
    want = [
        "duplicate id", "empty intent", "empty query", "empty tech_area", "expected_source_types duplicate", "forbidden_domains count", "forbidden_domains duplicate", "invalid category", "invalid difficulty", "invalid source_type",
        "must_contain_domains duplicate", "must_contain_domains empty entry", "must_contain_terms count", "type differs from category",
    ]
    assert [i for _, i in got] == want
    assert scoring.set_issues(spark.createDataFrame([], s)).count() == 0


def test_articles_of_all_pages(spark, tiny):
    got = queries.extracted_articles(spark, tiny).collect()
    pages = {r.content_id: r for r in spark.read.parquet(f"{tiny}/content_cache.parquet").collect()}
    plain = {r.content_id: r for r in queries.extracted_texts(spark, tiny).collect()}
    assert {r.content_id for r in got} == set(pages)
    for r in got:
        if r.content_id in plain:
            assert r == plain[r.content_id]
        elif r.error is None:
            from gleanwork.operators.articles import main_text

            assert r.chars <= len(main_text(pages[r.content_id].content)[0]) + 20


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, tiny, name):
    df = queries.queries()[name](spark, tiny)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("questions", "search_hits", "content_cache", "fetch_attempts", "json_sources", "module_manifests"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    cursor = con.execute(oracle.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else f"decimal {v}" if isinstance(v, Decimal) else v
    want = sorted((tuple(flat(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(flat(x) for x in r) for r in df.collect()), key=repr) == want
