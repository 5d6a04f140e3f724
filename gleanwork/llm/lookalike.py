"""One consistent form for text that looks the same but differs in characters.

Look-alike classes are found by union-find over strings and code points: width and font variants, kinds of
space, invisible characters (alike to the empty string), a letter with its accent and the composed letter, and
letters of other scripts of the same shape. Only strings that can be made of code points of the corpus take
part. Each class is represented by its most frequent member, and text is rewritten greedily, longest match
first, with one automaton over all members. Case, accents, superscripts, fractions, trademark signs, quotes
and dashes stay apart, as they look different.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.session import spread, written

# Letters of Cyrillic and Greek that have the shape of a Latin letter, and hyphens of the shape of "-".
SHAPES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԁ": "d",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-",
}
_ALIKE_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_WORD = re.compile(r"[^\W\d_]+")


def _like(c: str) -> str | None:
    """The string that code point c looks like by its Unicode properties, or None."""
    kind = unicodedata.category(c)
    if c == "　" or kind == "Zs":
        return " "
    if kind == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or c in "͏ᅟᅠㅤﾠ᠎":
        return ""
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if not tag.startswith("<"):
        return unicodedata.normalize("NFC", c) if rest == "" and tag else None  # singletons such as the ohm sign
    plain = "".join(chr(int(x, 16)) for x in rest.split())
    if tag in _ALIKE_TAGS or tag == "<compat>" and (kind[0] == "L" or 0x2E80 <= ord(c) <= 0x2FDF):
        return plain
    return None


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, s: str) -> str:
        while (p := self.up.setdefault(s, s)) != s:
            self.up[s] = s = self.up.setdefault(p, p)
        return s

    def union(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in sorted(self.up):
            out.setdefault(self.find(s), []).append(s)
        return out


def look_alikes(counts: dict[str, int]) -> dict[str, str]:
    """Rewrites {member: representative} of all classes over the code points in counts, each with its number of uses."""
    classes = Classes()
    seen = set(counts)
    for c in sorted(seen):
        like = SHAPES.get(c) or _like(c)
        if like is not None and like != c:
            classes.union(c, like)
            seen |= set(like)
    for m in [m for m in seen if unicodedata.combining(m)]:
        classes.find(m)
    alike: dict[str, set[str]] = {}
    for members in classes.members().values():
        for s in members:
            alike[s] = {x for x in members if len(x) == 1}
    for o in range(0xC0, sys.maxunicode + 1):  # composed characters whose parts occur in some variant
        parts = unicodedata.decomposition(chr(o))
        if not parts or parts[0] == "<" or parts.count(" ") != 1:
            continue
        base, mark = (chr(int(x, 16)) for x in parts.split())
        bases, marks = alike.get(base, {base}), alike.get(mark, {mark})
        if (bases & seen) and (marks & seen) or chr(o) in seen:
            for b in bases | {base}:
                for m in marks | {mark}:
                    if b + m != chr(o):
                        classes.union(b + m, chr(o))
    uses = lambda s: min((counts.get(c, 0) for c in s), default=0)
    rewrites = {}
    for members in classes.members().values():
        if "" in members:
            best = ""
        else:
            best = min(members, key=lambda s: (-uses(s), len(s), s))
        rewrites |= {s: best for s in members if s != best}
    for c in seen:  # joiners and selectors inside an emoji change how it looks and stay
        if unicodedata.category(c) == "So":
            for follow in ("️", "‍", "️‍"):
                rewrites[c + follow] = c + follow
    return rewrites


class Rewriter:
    def __init__(self, rewrites: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for s, best in rewrites.items():
            self.automaton.add_word(s, (len(s), best))
        self.automaton.make_automaton()
        self.some = bool(rewrites)
        back = {}
        for c, like in SHAPES.items():  # words with letters only Cyrillic has get their other letters back
            if _CYRILLIC.match(c) and ord(c) in range(0x410, 0x450):
                back[ord(like)] = c
        self.back, self.latin = back, {ord(c): like for c, like in SHAPES.items() if _CYRILLIC.match(c)}

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.some or text.isascii():
            return text
        out, at = [], 0
        for end, (n, best) in self.automaton.iter_long(text):
            start = end - n + 1
            if start > at:
                out.append(text[at:start])
            out.append(best)
            at = end + 1
        out = "".join(out) + text[at:]
        return self.scripted(out) if _CYRILLIC.search(out) else out

    def scripted(self, text: str) -> str:
        """text with each word in one script, whichever script represents the letters that both have.

        A word with a letter that only Cyrillic has is Cyrillic, one with a letter that only Latin has is Latin; of
        others, all of whose letters look alike in both, the script is that of most words that can be told. What
        looks the same stays the same.
        """
        told = {}
        for w in set(_WORD.findall(text)):
            if any(_CYRILLIC.match(c) and ord(c) not in self.latin for c in w):
                told[w] = "cyrillic"
            elif any(c.isascii() and ord(c) not in self.back for c in w):
                told[w] = "latin"
        words = [told.get(w) for w in _WORD.findall(text)]
        most = "cyrillic" if words.count("cyrillic") > words.count("latin") else "latin"
        return _WORD.sub(lambda m: m[0].translate(self.back if told.get(m[0], most) == "cyrillic" else self.latin), text)


def code_point_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Uses of each code point in all texts; the result has at most as many entries as Unicode has code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            for i in range(batch.num_columns):
                text = "".join(t for t in batch.column(i).to_pylist() if t)
                c = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["c", "n"])

    counts = df.select(*columns).mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n")).collect()
    return {chr(r[0]): r[1] for r in counts}


def uniform(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, and of each of columns its consistent form `<column>_form`; null and empty values stay as they are.

    Values that look the same get the same form. Classes and representatives come from the whole of df.
    """
    texts = spread(df.select(*keep, *columns))
    held = df.sparkSession.sparkContext.broadcast(look_alikes(code_point_counts(texts, columns)))  # bounded by Unicode
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(held.value)
        for batch in batches:
            forms = [pa.array([rewrite(t) for t in batch.column(n + i).to_pylist()], pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *forms], names=[*keep, *columns, *(f"{c}_form" for c in columns)])

    fields = [*texts.schema.fields, *(T.StructField(f"{c}_form", T.StringType()) for c in columns)]
    return texts.mapInArrow(run, T.StructType(fields))


def _spellings(df: DataFrame, columns: list[str], group_col: str, id_col: str) -> DataFrame:
    """(g, id, field, k, v): of each group and field the rows whose form is spelt in several ways, with digests of form and value."""
    forms = uniform(df.where(F.col(group_col).isNotNull()), columns, [group_col, id_col])
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), F.col(f"{c}_form").alias("form")) for c in columns))
    rows = forms.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), F.inline(fields)).where("value <> ''")
    rows = written(rows.select("g", "id", "field", F.xxhash64("g", "field", "form").alias("k"), F.xxhash64("value").alias("v")), "lookalike-forms")
    mixed = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("k")
    return written(rows.join(mixed, "k", "left_semi"), "lookalike-mixed")


def alike_classes(df: DataFrame, columns: list[str], group_col: str = "question_id", id_col: str = "hit_id") -> DataFrame:
    """(field, id_col, class_id, spelling_id, links): a row for each row whose value of field has a look-alike in its group.

    Rows of one class look the same, those of one spelling are equal; links is the number of rows of the class that are
    spelt otherwise. No pairs are made, so a form that a third of all rows have costs a row each.
    """
    few = _spellings(df, columns, group_col, id_col)
    of_spelling = few.groupBy("k", "v").count()
    of_class = of_spelling.groupBy("k").agg(F.sum("count").alias("all"))
    links = of_spelling.join(of_class, "k").select("k", "v", (F.col("all") - F.col("count")).alias("links"))
    return few.join(links, ["k", "v"]).select("field", F.col("id").alias(id_col), F.col("k").alias("class_id"), F.col("v").alias("spelling_id"), "links")


def alike_pairs(df: DataFrame, columns: list[str], group_col: str = "question_id", id_col: str = "hit_id") -> DataFrame:
    """(field, <id>_a, <id>_b) with id_a < id_b: pairs of rows of the same non-null group whose values of field
    look the same but differ in characters. Null and empty values form no pairs; repeated ids form none with themselves.

    Forms and values travel as 64-bit digests, which are compared within a group and field only. Only values of groups
    that hold two spellings of a form go on to the pair join, which pairs spellings, not rows; rows are joined to
    the pairs of spellings last, so that nothing but result rows is enumerated. alike_classes gives the same links
    without pairs.
    """
    few = _spellings(df, columns, group_col, id_col)
    key = ["k", "g", "field"]
    spellings = few.select(*key, "v").distinct()
    pairs = spellings.join(spellings.withColumnRenamed("v", "w"), key).where("v < w")
    left, right = few.select(*key, "v", F.col("id").alias("x")), few.select(*key, F.col("v").alias("w"), F.col("id").alias("y"))
    both = pairs.join(left, [*key, "v"]).join(right, [*key, "w"]).where("x <> y")
    return both.select("field", F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))
