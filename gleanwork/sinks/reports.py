"""Reports of roll-ups as Markdown and JSON, and the cache table.

Only aggregated rows (a row for each category, at most 20 extremes) pass the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.texts import table_cell
from gleanwork.values import DIFFICULTIES


def markdown_table(df: DataFrame, columns: list[str], digits: int = 1) -> str:
    """df, a small aggregate, as a Markdown table in its order; null is -."""
    cells = [F.when(F.col(c).isNull(), "-").otherwise(table_cell(F.format_string(f"%.{digits}f", c) if dict(df.dtypes)[c] == "double" else F.col(c).cast("string"))).alias(c) for c in columns]
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in df.select(*cells).collect())])


def quality_report(title: str, categories: DataFrame, extremes: DataFrame, id_col: str) -> str:
    """A Markdown report: the composite over all rows, the categories by name, the worst and the best rows."""
    ordered = categories.orderBy(F.col("category").isNull(), "category")
    worst = extremes.orderBy(F.desc("side"), "composite", id_col)
    return f"# {title}\n\n## Categories\n\n{markdown_table(ordered, ['category', 'n', 'mean', 'p50', 'p95'])}\n\n## Worst and best\n\n{markdown_table(worst, ['side', id_col, 'composite'])}\n"


def failure_list(failures: DataFrame) -> str:
    """Failures as a Markdown list by query_id; failures: (query_id, category, error), of a run's questions."""
    rows = failures.orderBy("query_id").select(F.concat(F.lit("- "), table_cell(F.col("query_id")), F.lit(": "), table_cell(F.col("error")))).collect()
    return "## Failures\n\n" + ("\n".join(r[0] for r in rows) if rows else "none")


def fetch_report(title: str, by_difficulty: DataFrame, by_type: DataFrame, by_layer: DataFrame) -> str:
    """A Markdown report of fetching: success by difficulty, by content type, and the layers that won; all small aggregates."""
    place = F.array_position(F.array(*map(F.lit, DIFFICULTIES)), F.col("difficulty"))
    parts = [
        ("Success by difficulty", markdown_table(by_difficulty.orderBy(place), ["difficulty", "urls", "fetched", "rate", "mean_ms"])),
        ("Success by content type", markdown_table(by_type.orderBy("media_type"), ["media_type", "urls", "fetched"])),
        ("Layers of successful fetches", markdown_table(by_layer.orderBy(F.desc("urls"), "layer"), ["layer", "urls", "share"])),
    ]
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{text}" for name, text in parts) + "\n"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
