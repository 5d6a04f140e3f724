"""Template residue and error-page text: rows that hold placeholders, filler or a notice in place of content.

One automaton holds the multilingual notices and fillers, each as it is and as the usual wrong decodings garble it; it runs
over every whole text, and only texts it or a placeholder pattern touches are looked at by lines. A notice counts
if the lines that hold notices cover most of the text that is neither page furniture nor the page's own title; a
placeholder or filler counts wherever a line outside code uses it and does not quote it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm import residue_words as W
from gleanwork.llm.boilerplate import furniture_lines, read_lines, repaired, with_templates
from gleanwork.llm.caps import url_host
from gleanwork.llm.mojibake import CYRILLIC_READ, LATIN_READ, LEGACY, SINGLE_BYTE
from gleanwork.llm.subjects import COMMON_WORDS
from gleanwork.session import spread

#: Share of the text that notices must cover; share of a title that residue must cover.
COVERAGE, TITLE_COVERAGE = 0.6, 0.5
#: Share of a line that notices must cover for the line to be one.
LINE_COVERAGE = 0.3
#: Dummy text has so many of its usual words, this share of a line, and none that only living languages have.
LATIN_WORDS, LATIN_SHARE = 2, 0.1

_lines = lambda text: [x for x in text.strip().split("\n") if x]
NOTICES, NOTICE_TITLES, FILLERS = _lines(W.NOTICES), _lines(W.NOTICE_TITLES), _lines(W.FILLERS)
LATIN, FIELDS = frozenset(W.LATIN.split()), frozenset(W.FIELDS.split())
_LIVING = frozenset(" ".join(COMMON_WORDS.values()).split()) - LATIN - {"a", "in", "et", "est", "de", "non"}

_PLACEHOLDER = re.compile(W.PLACEHOLDER)
_NOTICE_SHAPE, _NEUTRAL, _FILLER_SHAPE = (re.compile("|".join(x), re.I) for x in (W.NOTICE_SHAPES, W.NEUTRAL_SHAPES, W.FILLER_SHAPES))
_TITLE_NOTICE = re.compile(r"\d* ?\W? ?(?:" + "|".join(re.escape(x) for x in sorted({y for x in NOTICES for y in (x, x.rstrip(".…"))}, key=len, reverse=True)) + ")")
_QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|'[^'\n]{1,80}'|`[^`\n]{1,80}`|“[^”\n]{1,80}”|„[^“\n]{1,80}“|«[^»\n]{1,80}»|‘[^’\n]{1,80}’|「[^」\n]{1,80}」")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_KEY = re.compile(r"^[a-z]+(?:\.[a-z_]+)*\.[a-z]+_[a-z_]+$")


def _read_as(raw: bytes, codec: str) -> str | None:
    if codec == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    try:
        return raw.decode(codec)
    except UnicodeError:
        return None


def garbled(phrase: str) -> set[str]:
    """A phrase in lower case as it is and as one wrong decoding, or two as cp1252, make it, whether or not it began with a capital."""
    out = {phrase}
    if phrase.isascii():
        return out
    for text in {phrase, phrase.capitalize()}:
        raws = [(text.encode("utf-8"), (*SINGLE_BYTE, "gbk", "shift_jis", "big5"))]
        for codec in LEGACY:
            try:
                raws.append((text.encode(codec), (*LATIN_READ, *CYRILLIC_READ, *LEGACY)))
            except UnicodeError:
                continue
        once = [t for raw, codecs in raws for c in codecs if (t := _read_as(raw, c))]
        twice = _read_as(text.encode("utf-8"), "cp1252").encode("utf-8")
        out.update(t.lower() for t in (*once, _read_as(twice, "cp1252")) if len(t) > 3)
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    latin = [f" {w}" for w in LATIN if len(w) > 3]
    for kind, phrases in (("latin", latin), ("cue", W.FILLER_CUES), ("filler", FILLERS), ("notice", NOTICES)):
        for x in phrases:
            for t in garbled(x):
                a.add_word(t, (kind, len(t)))
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def _placeholders(text: str) -> list[str]:
    """Placeholders that a template would have filled with content; those of shells, charts and format strings aside."""
    found = []
    for m in _PLACEHOLDER.finditer(_QUOTED.sub(" ", text)):
        p = m[0]
        words = set(_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", p).lower()))
        if re.match(r"\{\{-? ?\.", p) or p.startswith("${") and p[2:-1].isupper():
            continue
        if p[:2] in ("*|", "%%", "{%", "[[", "@@") or p[0] in "<&" or re.fullmatch(r"\{\d\}", p) or words & FIELDS or words & {"id"} or _KEY.match(p):
            found.append(p)
    return found


def _latin(text: str) -> bool:
    words = _WORDS.findall(text.lower())
    known = [w for w in words if w in LATIN]
    return len(words) >= 5 and len(set(known)) >= LATIN_WORDS and len(known) >= LATIN_SHARE * len(words) and _LIVING.isdisjoint(words)


def _holds_notice(text: str) -> bool:
    """Whether notices that aren't quoted cover a good part of a line."""
    low = text.lower()
    spans = [(end - n + 1, end + 1) for end, (kind, n) in AUTOMATON.iter(low) if kind == "notice"]
    if not spans or _NOTICE_SHAPE.search(low):
        return _NOTICE_SHAPE.search(low) is not None
    quoted = [m.span() for m in _QUOTED.finditer(low)]
    covered = last = 0
    for a, b in sorted(s for s in spans if not any(x <= s[0] and s[1] <= y for x, y in quoted)):
        covered += max(b - max(a, last), 0)
        last = max(last, b)
    return covered >= LINE_COVERAGE * len(low) and covered > 0


def title_residue(title: str | None) -> bool:
    """Whether a title is a placeholder, filler or the title of an error, access or loading page."""
    if not title or not title.strip():
        return False
    for t in (title, *(() if title.isascii() else repaired(title))):
        low = _DIGITS.sub("0", t.strip().lower())
        if low in NOTICE_TITLES or low.split("-")[0] in NOTICE_TITLES and _PLACEHOLDER.search(t):
            return True
        if sum(map(len, _placeholders(t))) >= TITLE_COVERAGE * len(t.strip()):
            return True
        bare = low.rstrip(".…!")
        if _TITLE_NOTICE.fullmatch(bare):
            return True
        if any(x in low and len(x) >= TITLE_COVERAGE * len(low) for x in FILLERS) or _FILLER_SHAPE.search(low) or _latin(t):
            return True
    return False


def text_residue(content: str | None, title: str | None = None, host: str | None = None, templates: tuple = ()) -> bool:
    """Whether a text holds an unfilled placeholder or filler, or is a notice in place of content.

    templates: what furniture_lines takes of the pages' counts.
    """
    if not content or not content.strip():
        return False
    found = Counter(kind for _, (kind, _) in AUTOMATON.iter(content.lower()))
    notice, filler = found["notice"] > 0, found["filler"] + found["cue"] > 0 or found["latin"] > 0
    template = _PLACEHOLDER.search(content) is not None or "_" in content
    if not notice and not template and not filler:
        return False
    lines = read_lines(content)
    if template or filler:
        for line in lines:
            if template and not (line.mark == "code" and (line.raw.lstrip().startswith("<") or line.fenced)) and _placeholders(line.text or line.raw):
                return True
            if not filler or line.fenced:
                continue
            bare = _QUOTED.sub(" ", line.text).lower()
            if any(x in bare and len(x) >= COVERAGE * len(bare) for x in FILLERS) or _FILLER_SHAPE.search(bare) or _latin(line.text):
                return True
    if not notice:
        return False
    gone = set(furniture_lines(content, title, host, *templates, lines=lines))
    own = (title or "").strip()
    covered = left = 0
    for line in lines:
        if line.no in gone:
            continue
        held = _holds_notice(line.text)
        if not held and (line.text == own or _NEUTRAL.search(line.text)):
            continue
        left += len(line.text)
        covered += len(line.text) if held else 0
    return covered > 0 and covered >= COVERAGE * left


def find_residue(pages: DataFrame, id_col: str = "content_id", title_col: str = "title", content_col: str = "content", url_col: str = "url", layer_col: str = "layer_used") -> DataFrame:
    """(id_col, in_title, in_content): a row for each row of pages whose title or content holds residue.

    Null, empty and blank values hold none. Repeated rows give theirs again; other columns play no part, whatever
    their names. What hosts repeat is counted over all pages while this is called; the rest is a narrow map.
    """
    layer = F.col(layer_col) if layer_col in pages.columns else F.lit(None).cast("string")
    rows = spread(pages.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.col(content_col).alias("content"), url_host(F.col(url_col)).alias("host"), layer.alias("layer")))
    joined, templates = with_templates(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, in_title, in_content = [], [], []
            for i, (title, content, host, layer, lines) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)))):
                a, b = title_residue(title), text_residue(content, title, host, templates.value.of(host, layer, lines))
                if a or b:
                    at.append(i)
                    in_title.append(a)
                    in_content.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(in_title, pa.bool_()), pa.array(in_content, pa.bool_())], names=[id_col, "in_title", "in_content"])

    fields = [T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("in_title", T.BooleanType()), T.StructField("in_content", T.BooleanType())]
    return joined.select("id", "title", "content", "host", "layer", "lines").mapInArrow(run, T.StructType(fields))
