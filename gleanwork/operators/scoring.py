"""Quality of answers against a ground truth, and its roll-up to categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.urls import ends_with_domain
from gleanwork.operators.hits import previous
from gleanwork.operators.ranking import percentiles
from gleanwork.values import ANSWER_WEIGHTS, CATEGORIES, DIFFICULTIES, SOURCE_NAMES, TRUTH_BOUNDS


def share_spared(used: Column, budget: float) -> Column:
    """1 - used / budget within [0, 1]; 1 if either is not positive."""
    return F.when((used <= 0) | F.lit(budget <= 0), F.lit(1.0)).otherwise(1 - F.least(used / F.lit(budget), F.lit(1.0)))


def distinct_terms(terms: Column) -> Column:
    """Trimmed, in lower case, without empty ones; of equal ones the first."""
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def domain_hit_rate(required: Column, domains: Column) -> Column:
    """Share of required domain patterns that some domain matches; 1 if none is required."""
    wanted = distinct_terms(required)
    hit = F.filter(wanted, lambda p: F.exists(domains, lambda d: ends_with_domain(d, p)))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(hit) / F.size(wanted))


def term_coverage(terms: Column, answer: Column) -> Column:
    """Share of terms that the answer holds, without case; 1 if none is required, 0 for an empty answer."""
    wanted, text = distinct_terms(terms), F.lower(F.coalesce(answer, F.lit("")))
    found = F.filter(wanted, lambda t: F.contains(text, t))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).when(F.trim(text) == "", F.lit(0.0)).otherwise(F.size(found) / F.size(wanted))


def pollution(forbidden: Column, domains: Column) -> Column:
    """1 minus the share of domains that match a forbidden pattern; 1 without domains."""
    bad = F.filter(domains, lambda d: F.exists(forbidden, lambda p: ends_with_domain(d, p)))
    return F.when(F.size(domains) == 0, F.lit(1.0)).otherwise(1 - F.size(bad) / F.size(domains))


def diversity(expected: Column, cited: Column) -> Column:
    """Share of the expected source types that are cited; 1 if none is expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(wanted, cited)) / F.size(wanted))


def composite(metrics: dict[str, Column]) -> Column:
    """Weighted sum in percent, within [0, 100]."""
    total = sum((F.lit(w) * metrics[name] for name, w in ANSWER_WEIGHTS.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100))


def top_by_rank(citations: Column, most: int) -> Column:
    """The first `most` of an array of (rank, pos, ...) structs: positive ranks ascending, then the others as they stand."""
    keyed = F.transform(citations, lambda c: F.struct((c["rank"] <= 0).alias("last"), F.when(c["rank"] > 0, c["rank"]).otherwise(0).alias("rank"), c["pos"].alias("pos"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda k: k["c"])


def by_category(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(category, n, mean, p50, p95, avg_<metric>...) for each category, and with a null category over all.

    One aggregation over grouping sets; percentiles are nearest-rank, from histograms. scores is read three times, so
    pass a written table where it is dear.
    """
    known = scores.where("category IS NOT NULL").select("category", "composite", *metrics)
    aggregates = [F.count("*").alias("n"), F.avg("composite").alias("mean"), *(F.avg(m).alias(f"avg_{m}") for m in metrics)]
    sums = scores.groupingSets([["category"], []], "category").agg(F.grouping("category").alias("whole"), *aggregates).where("category IS NOT NULL OR whole = 1")
    both = known.select("category", F.col("composite").alias("v")).unionByName(scores.select(F.lit(None).cast("string").alias("category"), F.col("composite").alias("v")))
    ranks = percentiles(both, ["category"], "v", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("category", "_c")
    return sums.join(ranks, F.col("category").eqNullSafe(F.col("_c")), "left").select("category", "n", "mean", "p50", "p95", *(f"avg_{m}" for m in metrics))


def extremes(scores: DataFrame, id_col: str, most: int = 10) -> DataFrame:
    """(side, id_col, composite): the worst and the best `most` rows, ties by id."""
    worst = scores.orderBy("composite", id_col).limit(most).select(F.lit("worst").alias("side"), id_col, "composite")
    best = scores.orderBy(F.desc("composite"), id_col).limit(most).select(F.lit("best").alias("side"), id_col, "composite")
    return worst.unionByName(best)


def category_place(category: Column) -> Column:
    """Where a category stands in reports; unknown ones are last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), category), F.lit(0)), F.lit(len(CATEGORIES) + 1).cast("long"))


def failures(results: DataFrame) -> DataFrame:
    """(query_id, category, error) of results with an error, as the report lists them by query_id."""
    return results.where("error <> ''").select("query_id", "category", "error")


def set_issues(queries: DataFrame) -> DataFrame:
    """(query_id, issue): what breaks the rules of a query set, a row for each.

    queries: (query_id, pos, category, type, query, intent, difficulty, tech_area, canonical_answer, must_contain_domains,
    must_contain_terms, forbidden_domains, expected_source_types ARRAY<STRING>). Texts are empty if null. Of rows with one id
    all but the first by pos are duplicates. List entries are compared trimmed and in lower case.
    """
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = [F.when(text(c) == "", F.lit(f"empty {c}")) for c in ("query", "intent", "tech_area", "canonical_answer")]
    rules += [F.when(text("query_id") == "", F.lit("empty id")), F.when(text("type") != text("category"), F.lit("type differs from category"))]
    rules += [F.when(~text("category").isin(CATEGORIES), F.lit("invalid category")), F.when(~text("difficulty").isin(DIFFICULTIES), F.lit("invalid difficulty"))]
    for c, (least, most) in TRUTH_BOUNDS.items():
        rules.append(F.when(~F.size(F.coalesce(F.col(c), none)).between(least, most), F.lit(f"{c} count")))
    kinds = F.coalesce(F.col("expected_source_types"), none)
    rules += [F.when(F.size(kinds) < 1, F.lit("expected_source_types empty")), F.when(F.exists(kinds, lambda t: ~t.isin(*SOURCE_NAMES)), F.lit("invalid source_type"))]
    for c in (*TRUTH_BOUNDS, "expected_source_types"):
        entries = F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(F.trim(x)))
        filled = F.filter(entries, lambda x: x != "")
        rules += [F.when(F.exists(entries, lambda x: x == ""), F.lit(f"{c} empty entry")), F.when(F.size(F.array_distinct(filled)) < F.size(filled), F.lit(f"{c} duplicate"))]
    found = queries.select("query_id", F.explode(F.array_compact(F.array(*rules))).alias("issue"))
    again = previous(queries.where("query_id <> ''"), F.col("query_id"), ["pos"]).select("query_id", F.lit("duplicate id").alias("issue"))
    return found.unionByName(again)
