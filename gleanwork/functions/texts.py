"""Text functions as column expressions; lengths that decide are bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.values import CUT_NOTE, NOISE_LINES, STOP_WORDS


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case, of 2 bytes or more, without stop words; repeats stay."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOP_WORDS))


def keyword_overlap(question_tokens: Column, title: Column, snippet: Column) -> Column:
    """Share of the question's tokens that occur in title and snippet; 0 without tokens."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))
    n = F.size(question_tokens)
    return F.when(n > 0, F.size(F.filter(question_tokens, lambda t: F.contains(text, t))) / n).otherwise(F.lit(0.0))


def snippet_score(snippet: Column, steps: list[tuple[int, float]]) -> Column:
    """Score of the first step whose bytes the snippet reaches, steps from long to short; null counts as empty."""
    size, out = F.octet_length(F.coalesce(snippet, F.lit(""))), F.lit(0.0)
    for least, score in sorted(steps):
        out = F.when(size >= least, F.lit(score)).otherwise(out)
    return out


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{2,}", "\n")


def strip_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+(\n|$)", "$1")


def drop_noise(text: Column) -> Column:
    """text without lines that, trimmed, begin as page noise does; blank lines stay."""
    pattern = "|".join(f"(?:{p})" for p in NOISE_LINES)
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).rlike(pattern)), "\n")


def cut_to(text: Column, most: int, note: str = CUT_NOTE) -> Column:
    """text of at most `most` characters, cut back to the last blank within the last quarter, with a note if cut."""
    head = F.substring(text, 1, most)
    word = F.regexp_extract(head, r"(?s)^(.*)[ \n\t]", 1)
    kept = F.when(F.length(word) > most * 3 // 4, word).otherwise(head)
    return F.when(F.length(text) > most, F.concat(kept, F.lit(note))).otherwise(text)


def shortened(text: Column, most: int) -> Column:
    """text in one line; of more than `most` characters the first, with three dots as the last of them."""
    flat = one_line(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def markdown_title(text: Column) -> Column:
    """The first heading of level 1 among the first 20 lines, else null."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.trim(x))
    return F.trim(F.substring(F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), F.lit(0)), 3, 1 << 20))


def media_type(content_type: Column) -> Column:
    return F.trim(F.substring_index(F.lower(content_type), ";", 1))


def tag_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<[a-zA-Z][^>]*>"))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, trimmed, of more than 20 bytes."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: F.octet_length(p) > 20)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def table_cell(text: Column) -> Column:
    """text as a cell of a Markdown table."""
    return F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("|"), F.lit(r"\|"))


def unfenced(text: Column) -> Column:
    """JSON without a thinking part before it and without a fence around it."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    s = bare(F.regexp_replace(text, r"(?s)^.*?</think>", ""))
    return bare(F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?", ""), r"```$", ""))


def confidence(value: Column) -> Column:
    return F.when(value.isin("high", "medium", "low", "insufficient"), value).otherwise(F.lit("medium"))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def milliseconds(ms: Column) -> Column:
    """A duration as reports write it, rounded down: 850ms, 12.3s, 2m05s; null and negative ones are -."""
    s = F.floor(ms / 1000)
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms.isNull() | (ms < 0), "-").when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(s.cast("string"), F.lit("."), (F.floor(ms / 100) % 10).cast("string"), F.lit("s"))).otherwise(long)
