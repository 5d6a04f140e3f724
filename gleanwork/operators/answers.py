"""Plans and answers as JSON texts, prompts from sources, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import texts
from gleanwork.operators.ranking import numbered
from gleanwork.values import CUT_NOTE, PROMPT_BYTES, SOURCE_NAMES

PLAN = "struct<rationale:string,queries_by_source_type:map<string,array<string>>,expected_answer_shape:string>"
ANSWER = "struct<answer:string,citations:array<struct<id:int,url:string,title:string,source_type:string>>,confidence:string>"
RESPONSE = "struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>>>"


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def source_type_of(name: Column) -> Column:
    """The source type that a key of a plan means, whatever its case and with - as _; general_web if none."""
    n = F.lower(F.replace(name, F.lit("-"), F.lit("_")))
    out = F.lit("general_web")
    for kind, names in SOURCE_NAMES.items():
        out = F.when(n.isin(names.split()), F.lit(kind)).otherwise(out)
    return out


def _asked(queries: Column) -> Column:
    """Whether a map of lists holds a query."""
    return F.coalesce(F.size(F.map_filter(queries, lambda k, v: F.size(F.filter(v, lambda q: q != "")) > 0)) > 0, F.lit(False))


def _listed(value: Column) -> Column:
    """The texts of a VARIANT if it is an array; others of its elements and anything else give none."""
    each = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.filter(F.transform(each, lambda x: F.try_variant_get(x, "$", "string")), lambda q: q != "")


def recovered_queries(text: Column) -> Column:
    """Map of queries by source type harvested from any JSON: lists of texts, up to three objects deep, by what their key means.

    Keys that mean the same type join their lists in the order of the keys; a list under no known key is general_web.
    """
    fields = lambda c: F.map_entries(F.try_variant_get(c, "$", "map<string,variant>"))
    pairs = lambda entries: F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    deeper = lambda level: F.flatten(F.filter(F.transform(level, lambda e: pairs(fields(e["v"]))), lambda x: x.isNotNull()))

    def by_kind(found: Column) -> Column:
        lists = F.filter(F.transform(found, lambda e: F.struct(source_type_of(e["k"]).alias("t"), _listed(e["v"]).alias("q"))), lambda s: F.size(s["q"]) > 0)
        return _bound(lists, lambda held: _bound(F.array_distinct(F.transform(held, lambda s: s["t"])), lambda kinds: F.map_from_arrays(kinds, F.transform(kinds, lambda t: F.flatten(F.transform(F.filter(held, lambda s: s["t"] == t), lambda s: s["q"]))))))

    def harvested(tree: Column) -> Column:
        first = F.coalesce(pairs(fields(tree)), F.array(F.struct(F.lit("").alias("k"), tree.alias("v"))))  # a list by itself has no key
        return _bound(first, lambda top: _bound(deeper(top), lambda second: by_kind(F.concat(top, second, deeper(second)))))

    return _bound(F.try_parse_json(text), harvested)


def parsed_plan(raw: Column) -> Column:
    """Struct (queries MAP, rationale, error) of a plan's JSON, fenced or not, by the first form that holds a query.

    The enveloped form holds plan or queries_by_source_type; the flat form is the map itself, by source types; else
    lists of texts are harvested wherever they stand (recovered_queries). A text that is no JSON has the error
    `invalid plan JSON`, a map without a query `zero queries`, anything else without one `missing queries`.
    """

    def judged(text: Column) -> Column:
        wrapped, full = F.from_json(text, f"struct<plan:{PLAN}>")["plan"], F.from_json(text, PLAN)
        flat = F.map_filter(F.from_json(text, "map<string,array<string>>"), lambda k, v: v.isNotNull() & k.isin(*SOURCE_NAMES))
        read = F.struct(
            F.coalesce(wrapped["queries_by_source_type"], full["queries_by_source_type"]).alias("named"), flat.alias("flat"), F.coalesce(wrapped["rationale"], full["rationale"]).alias("told"),
            F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False)).alias("valid"), text.alias("text"),
        )
        return _bound(read, chosen)

    def chosen(r: Column) -> Column:
        plain = F.when(_asked(r["named"]), r["named"]).when(_asked(r["flat"]), r["flat"])
        return _bound(plain, lambda given: _bound(F.when(given.isNull(), recovered_queries(r["text"])), lambda other: finished(r, given, F.when(_asked(other), other))))

    def finished(r: Column, given: Column, other: Column) -> Column:
        listed = F.coalesce(r["named"].isNotNull() | (F.size(r["flat"]) > 0), F.lit(False))
        queries = F.coalesce(given, other)
        error = F.when(~r["valid"], "invalid plan JSON").when(queries.isNotNull(), F.lit(None).cast("string")).when(listed, "zero queries").otherwise("missing queries")
        told = F.coalesce(r["told"], F.when(given.isNull() & queries.isNotNull(), F.lit("(recovered from another form)")))
        return F.struct(F.when(r["valid"], queries).alias("queries"), told.alias("rationale"), error.alias("error"))

    return _bound(texts.unfenced(raw), judged)


def plan_issues(raw: Column) -> Column:
    """What a plan's JSON has or lacks against its schema: an array of `missing <key>` and `unknown <key>`, empty if it fits."""
    keys = F.json_object_keys(texts.unfenced(raw))
    wanted = F.array(*map(F.lit, ("rationale", "queries_by_source_type", "expected_answer_shape")))
    lacks = F.transform(F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>"))), lambda k: F.concat(F.lit("missing "), k))
    return F.concat(lacks, F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), wanted), lambda k: F.concat(F.lit("unknown "), k)))


def attempted_plans(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, attempt, queries, error, input_tokens, output_tokens, cached_tokens) of each question: the first of `most` attempts whose plan holds a query.

    attempts: (question_id, attempt from 1, response), responses as model servers give them. Tokens are summed up to the
    attempt that counts; if none does, over the first `most`, with the last one's error and no queries. Attempts
    beyond `most` don't count; a response without a choice is an attempt with the error `no choices`.
    """
    read = F.from_json("response", RESPONSE)
    rows = attempts.where(F.col("attempt") <= most).withColumn("_r", read).withColumn("_c", F.get("_r.choices", F.lit(0))["message"]["content"])
    rows = rows.withColumn("_p", parsed_plan(F.col("_c")))
    error = F.when(F.col("_c").isNull(), F.lit("no choices")).otherwise(F.col("_p.error"))
    tokens = {"input_tokens": "_r.usage.prompt_tokens", "output_tokens": "_r.usage.completion_tokens", "cached_tokens": "_r.usage.prompt_tokens_details.cached_tokens"}
    one = F.struct("attempt", error.alias("error"), F.col("_p.queries").alias("queries"), *(F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in tokens.items()))
    # a question has at most `most` attempts
    by_attempt = lambda a, b: (a["attempt"] - b["attempt"]).cast("int")
    listed = rows.groupBy("question_id").agg(F.collect_list(one).alias("a")).withColumn("a", F.array_sort("a", by_attempt))
    won = F.get(F.filter("a", lambda x: x["error"].isNull()), F.lit(0))
    used = F.filter("a", lambda x: won.isNull() | (x["attempt"] <= won["attempt"]))
    last = F.coalesce(won, F.element_at("a", -1))
    total = lambda n: F.aggregate(F.transform(used, lambda x: x[n]), F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias(n)
    sums = [total(n) for n in tokens]
    return listed.select("question_id", last["attempt"].alias("attempt"), won["queries"].alias("queries"), F.when(won.isNull(), last["error"]).alias("error"), *sums)


def mended(text: Column) -> Column:
    """JSON whose backslashes start an escape: within strings the others are doubled, outside they are dropped."""
    good = r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})'
    marked = F.regexp_replace(text, f"({good})", "\x01$1")  # an escape is told by the mark before it
    doubled = F.regexp_replace(marked, r"(?<!\x01)(?<!\x01\\)\\", r"\\\\")
    plain = F.regexp_replace(doubled, "\x01", "")
    # what stands between strings holds no backslash in JSON
    return F.regexp_replace(plain, r'((?:^|[}\],:\[{])\s*)\\+(\s*["}\],:\[{]|$)', "$1$2")


def parsed_answers(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """raw with answer, citations, confidence, error. A text that is no JSON even with stray backslashes escaped has
    the error `invalid answer JSON`, one without an answer `empty answer`; an unknown confidence is medium.
    """
    text = texts.unfenced(F.col(raw_col))
    strict = F.from_json(text, ANSWER)
    rows = raw.withColumn("_t", text).withColumn("_s", strict)
    rows = rows.withColumn("_a", F.when(F.try_parse_json("_t").isNotNull(), F.col("_s")).otherwise(F.from_json(mended(F.col("_t")), ANSWER)))
    empty = F.coalesce(F.trim("_a.answer"), F.lit("")) == ""
    error = F.when(F.col("_a").isNull() | (F.col("_a.answer").isNull() & F.col("_a.citations").isNull()), F.lit("invalid answer JSON")).when(empty, F.lit("empty answer"))
    return rows.select(*raw.columns, F.col("_a.answer").alias("answer"), F.col("_a.citations").alias("citations"), texts.confidence(F.coalesce("_a.confidence", F.lit(""))).alias("confidence"), error.alias("error"))


def with_content(sources: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """sources with `content` of the page of the same url, null if it was not fetched; pages: (url, content), a url once."""
    return sources.join(pages.select(F.col(key).alias("_u"), "content"), F.col(key) == F.col("_u"), "left").drop("_u")


def fetched_only(sources: DataFrame) -> DataFrame:
    """Sources whose page was fetched."""
    return sources.where("content IS NOT NULL")


def prompts(sources: DataFrame, key: str = "run_id", most: int = 25) -> DataFrame:
    """(key, prompt, n_sources): the first `most` sources of each key by id whose page was fetched as one text, in order.

    sources: (key, id, source_type, score, url, title, content, row_id); ids are the numbers in the prompt. Contents over
    PROMPT_BYTES characters are cut with a note. Rows beyond the bound are dropped before anything is gathered.
    """
    first = numbered(fetched_only(sources), [key], F.floor(F.col("id") / 64), F.col("id"), "row_id", "n").where(F.col("n") <= most)
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = F.when(F.length("content") > PROMPT_BYTES, F.concat(F.substring("content", 1, PROMPT_BYTES), F.lit(CUT_NOTE))).otherwise(F.col("content"))
    block = F.concat(
        F.lit("SOURCE "), F.col("id").cast("string"), F.lit(" ["), none("source_type"), F.lit(" / score "), F.format_string("%.2f", F.coalesce("score", F.lit(0.0))), F.lit("]\nURL: "), none("url"),
        F.lit("\nTitle: "), none("title"), F.lit("\nContent:\n"), content, F.lit("\n\n"),
    )
    gathered = first.select(key, F.struct("n", block.alias("b")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return gathered.select(key, F.array_join(F.transform("s", lambda x: x["b"]), "").alias("prompt"), F.size("s").alias("n_sources"))


def conversations(turns: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, messages): the messages of each conversation as one JSON array of {role, content}, in the order of turn, then role.

    turns: (key, turn, role, content), a few a conversation; turns without content are left out.
    """
    one = F.struct("turn", "role", "content")
    gathered = turns.where("content <> ''").groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("m"))
    return gathered.select(key, F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))


def result_mode(answer: Column, sources: Column) -> Column:
    """What a result holds: `answer` with one, `sources` with sources only, else `empty`."""
    return F.when(F.coalesce(F.trim(answer), F.lit("")) != "", "answer").when(F.coalesce(sources, F.lit(0)) > 0, "sources").otherwise("empty")


def result_json(fields: dict[str, Column]) -> Column:
    """A result as JSON without fields that are null, empty or zero."""
    kept = {n: F.when(c.cast("string").isin("", "0", "0.0", "[]"), F.lit(None)).otherwise(c) for n, c in fields.items()}
    return F.to_json(F.struct(*(c.alias(n) for n, c in kept.items())), {"ignoreNullFields": "true"})


def merged_citations(cited: DataFrame, fetched: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, url, rank): the cited urls with their ids as ranks, then the fetched sources whose exact url isn't cited.

    These continue the ranks from the highest id (0 if nothing is cited), in the order of id, row_id. Both sides:
    (key, id, url, row_id); rows without a url are dropped.
    """
    cited, fetched = cited.where("url IS NOT NULL"), fetched.where("url IS NOT NULL")
    highest = cited.groupBy(key).agg(F.greatest(F.max("id"), F.lit(0)).alias("_top"))
    known = cited.select(F.col(key).alias("_k"), F.col("url").alias("_u")).distinct()
    rest = fetched.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("url") == F.col("_u")), "left_anti")
    rest = numbered(rest, [key], F.floor(F.col("id") / 64), F.col("id"), "row_id")
    rest = rest.join(highest.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left")
    tail = rest.select(key, "url", (F.coalesce("_top", F.lit(0)) + F.col("n")).alias("rank"))
    return cited.select(key, "url", F.col("id").alias("rank")).unionByName(tail)
