"""Values that lost their end, and how often each source cuts.

Lengths are recomputed as characters, UTF-8 bytes, UTF-16 units, bytes of GBK, Shift-JIS and Latin-1 with character references,
and after entity escaping, JSON escaping and newline conversion. Counted by source and ending, each exposes the limits at
which a source stores: a length up to which values pile up, within a few units or a word, with next to nothing
beyond. Then endings are inspected: a value at a limit of its source is cut unless a sentence ends there, whatever
else it looks like, and a bare "..." is a mark at a limit only. Away from limits a value is cut if it bears a mark,
a prompt to read on, an open fence, tag or link, if its last sentence stops, or if its last word is the start of
one. What is a word, and what starts a sentence rather than a heading, is counted over all values and joined.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm import truncation_words as W
from gleanwork.llm.boilerplate import _NOTICE, ITEMS, NONE, _cut_short, furniture_lines, read_lines, with_templates
from gleanwork.llm.caps import url_host
from gleanwork.session import spread, written

MEASURES = ("chars", "utf8", "utf16", "gbk", "shift_jis", "latin1", "entities", "json", "crlf")
#: How far below a limit values may end: at it, where a character would be split, and where a word would be.
SLACKS = (0, 3, 16)
#: A limit needs so many values within the widest slack, at so many times the density of the lengths before, less than this
#: share beyond, and last characters in so many of 63 hash buckets, as a closing that is repeated makes no limit.
PILE, TIMES, BEYOND, VARIED = 10, 4, 0.02, 7
#: The least slack that holds this share of the pile is the limit's.
HELD = 0.8
#: A word in use stands in so many places within lines. What ends a line is the start of one if it stands anywhere
#: less than this share as often as the longer word within lines; last words, cut or not, are no longer words.
USED, FRAGMENT_SHARE = 4, 0.02
#: Times a beginning must have been seen to tell sentences from headings.
SEEN = 5

_INVISIBLE = re.compile("[\\u00ad\\u034f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff\\ufe00-\\ufe0f]")
_MARK = re.compile(r"(?:" + "|".join(re.escape(m) for m in sorted(W.MARKS, key=len, reverse=True)) + r")\)?$")
_FULL = re.compile(r"(?:[.!?。！？؟]|(?<=[\w\d]):)['\"”’»›」』）)\]*_]*$")
#: A mark and its bracket are no longer than this, so only the end of a text is searched for one.
_MARK_CHARS = max(map(len, W.MARKS)) + 2
_STOPS, _CLOSERS = frozenset(".!?。！？؟"), "'\"”’»›」』）)]*_"
_STOP = re.compile("[.!?。！？]")
_INNER = re.compile(r"[.!?][\"”’»)]* +\S|[。！？]")
_SUFFIX = re.compile(r" \(\d[\d,.]* [^()]{1,12}\)$")
_PREFIX = re.compile(r"^(?:[^|]{0,120}\| [^|]{1,30} \| [^|]{1,40} \| |\[[^\]]{1,20}\] |(?:[^\s.]{1,3}\. \S+, )*[^\s.]{1,3}\. \S+ et al\. — |(?:[^\s.]{1,3}\. \S+, )*[^\s.]{1,3}\. \S+ — |\w{3,9} \d{1,2}, \d{4} — |… )")
_CODE = re.compile(r"[{}_=$<>\\]|;$|\w\(|^\W*[A-Z]{2,} |^[\w.\"-]+:( |$)|^--|^error\b")
_LAST_WORD = re.compile(r"[^\W\d_]+$")
_TAGS = re.compile(r"<[^>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_SPACES = re.compile("[\\u00a0\\u2000-\\u200a\\u202f\\u3000]")


def plain(text: str) -> str:
    """text without invisible characters and with one kind of space and width, as a reader sees its end."""
    if text.isascii():
        return text.rstrip()
    text = _SPACES.sub(" ", _INVISIBLE.sub("", text))
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" and c not in "，：；！？（）" else c for c in text).rstrip() if re.search("[０-ｚ．]", text) else text.rstrip()


def marked(text: str) -> re.Match | None:
    """The mark of a cut at the end of text."""
    return _MARK.search(text, max(len(text) - _MARK_CHARS, 0))


def full(text: str) -> bool:
    """Whether text ends as a sentence; as _FULL, which reads it from its start."""
    if text[-1:] == "\n":
        return _FULL.search(text) is not None
    t = text.rstrip(_CLOSERS)
    last = t[-1:]
    if last == ":":
        return t[-2:-1].isalnum() or t[-2:-1] == "_"
    return last in _STOPS


def inner(text: str) -> bool:
    """Whether a sentence ends within text."""
    m = _STOP.search(text)
    return m is not None and _INNER.search(text, m.start()) is not None


def bare(snippet: str) -> str:
    """A snippet without what its source puts before and behind the text."""
    s = plain(snippet)
    if m := _PREFIX.match(s):
        s = s[m.end() :]
    return _SUFFIX.sub("", s) if s[-1:] == ")" else s


def beginning(sentence: str) -> str:
    """The key by which sentence beginnings are counted: two words, or two characters of an unspaced script."""
    s = sentence.lstrip("\"'“”‘’«»„「『¿¡ *_-#")
    if s[:1] and _CJK.match(s):
        return s[:2]
    return " ".join(s.lower().split(" ", 2)[:2])


def ending(text: str) -> str:
    """`mark`, `dots` (a bare ...), `full`, or `open`."""
    m = marked(text)
    if m:
        return "dots" if m[0] == "..." else "mark"
    return "full" if full(text) else "open"


def last_word(text: str) -> str | None:
    """The word that text ends in, in lower case; null if it ends in none or in one of an unspaced script."""
    m = _LAST_WORD.search(unicodedata.normalize("NFC", text) if not text.isascii() else text)  # a loose accent ends no word
    return None if not m or _CJK.search(m[0]) else m[0].lower()


def lengths(text: str) -> tuple[int, ...]:
    """The lengths of text by each of MEASURES."""
    n, breaks = len(text), text.count("\n")
    escaped = len(escape(text)) if "&" in text or "<" in text or ">" in text or '"' in text or "'" in text else n
    json = n + text.count('"') + text.count("\\") + breaks
    if text.isascii():
        return n, n, n, n, n, n, escaped, json, n + breaks
    astral = len(text.encode("utf-16-le", "surrogatepass")) // 2 - n
    high = n - len(text.encode("ascii", "ignore"))
    coded = lambda codec, errors="replace": len(text.encode(codec, errors))
    return n, coded("utf-8", "surrogatepass"), n + astral, coded("gbk"), coded("shift_jis"), coded("latin-1", "xmlcharrefreplace"), escaped, json + 5 * high + 6 * astral, n + breaks


def unmarked(text: str) -> str:
    """text without the mark of a cut at its end."""
    m = marked(text)
    return (text[: m.start()] + text[m.end() :] if m else text).rstrip()


#: (field, source, ending) -> (place among MEASURES, length, slack).
Limits = dict[tuple[str, str, str], tuple[int, int, int]]


def at_limit(limits: Limits, name: str, source: str | None, text: str, kind: str) -> bool:
    found = limits.get((name, source or "", kind))
    return found is not None and found[1] - found[2] <= lengths(text)[found[0]] <= found[1]


#: What inspection says of a value: lost its end, whole, or open to what is counted.
CUT, WHOLE = (True, None, None, False), (False, None, None, False)


def asked(text: str, unknown: bool) -> tuple[bool, str | None, str | None, bool]:
    """(False, last word, beginning, whether an unknown beginning means a cut): cut if the word is a fragment or the beginning one of sentences."""
    sentence, key = _sentence_like(text)
    return False, last_word(text), key, sentence and unknown


def _sentence_like(text: str) -> tuple[bool, str | None]:
    """Whether an open text of one clause is the start of a sentence, not a list, heading or command; and the beginning that can tell better."""
    if _CODE.search(text):
        return False, None
    if _CJK.search(text):
        items = re.split("[、,，] ?", text)
        listed = len(items) > 1 and all(len(i) <= 10 and not re.search("[的在了却就把是はがをだ]", i) for i in items)
        return any(c in W.SENTENCE_CHARS for c in text) and not listed, None
    first = text.lstrip("\"'“”‘’«»„¿¡ *_")[:1]
    if first.islower() or not first:
        return False, None
    words = text.split()
    return len(words) >= 4 or len(words) == 1 and len(text) <= 2, beginning(text)


def snippet_cut(text: str | None, source: str | None, limits: Limits) -> tuple[bool, str | None, str | None, bool]:
    """Whether a snippet lost its end, as CUT, WHOLE or asked()."""
    if not text or not text.strip():
        return WHOLE
    s = bare(text)
    kind = ending(s)
    if kind == "mark":
        return CUT
    if kind == "full":
        return WHOLE
    if at_limit(limits, "snippet", source, unmarked(s), kind):
        return CUT
    if kind == "dots":
        return False, last_word(unmarked(s)), None, False
    if s.endswith("�") or inner(s):
        return CUT
    return asked(s, True)


def _html_open(raw: str) -> bool:
    """A line of HTML whose element isn't closed."""
    s = raw.strip()
    m = re.match(r"<([a-zA-Z][\w-]*)\b", s)
    return bool(m) and m[1].lower() not in ("br", "hr", "img", "input", "meta", "link") and not s.endswith((f"</{m[1]}>", "/>", f"<{m[1]}>"))


def content_cut(content: str | None, layer: str | None, title: str | None, host: str | None, limits: Limits, templates: tuple = ()) -> tuple[bool, str | None, str | None, bool]:
    """Whether a page text lost its end, be it followed by furniture or prompts, as CUT, WHOLE or asked()."""
    if not content or not content.strip():
        return WHOLE
    raws = content.rstrip().split("\n")
    end = raws[-1].strip()
    if end in W.NOTES or end.endswith(tuple(W.NOTES)):
        return CUT
    kind = ending(plain(raws[-1]))
    lines = read_lines(content)
    fences = sum(raw.lstrip().startswith("```") for raw in raws)
    if fences % 2 and not _closed_later(raws):
        return CUT
    html = sum(raw.lstrip().startswith("<") for raw in raws)
    if html > len(lines) / 2 and _html_open(end) or end.startswith("<") and ">" not in end or re.match(r"([*+-] )?\[[^\]]*(\](\([^)]*)?)?$", end) and "](" in content.replace(end, ""):
        return CUT
    gone = set(furniture_lines(content, title, host, *templates, lines=lines))
    labels = (host or "").split(".")
    brand = labels[-2] if len(labels) > 1 else labels[0]
    last = lines[-1]
    if kind != "full" and not _NOTICE.search(end.lower()) and at_limit(limits, "content", layer, unmarked(plain(content)), kind) and not (last.no in gone and last.text in ITEMS):
        return CUT
    if len(lines) > 1 and last.no in gone and _broken_furniture(last.text, brand):
        return CUT
    body = [x for x in lines if x.no not in gone]
    prompted = False
    while body and body[-1].text in W.PROMPTS:
        prompted = True
        body.pop()
    if prompted:
        return CUT
    if not body:
        return WHOLE
    x = body[-1]
    s = plain(x.text)
    kind = ending(s)
    if _NOTICE.search(s.lower()):
        return WHOLE  # an error page is whole as it is
    if kind == "mark":
        return CUT if len(s) > 12 and not s.lower().startswith(("loading", "please wait")) else WHOLE
    if kind == "dots":
        return False, last_word(unmarked(s)), None, False
    if kind == "full":
        return WHOLE
    if s == (title or "").strip() or x.mark in ("#", "h1", "h2", "h3") or x.item() or x.mark == "code":
        return (False, last_word(s), None, False) if x.no == last.no else WHOLE
    if s.endswith("�") and len(s) > 20 or inner(s):
        return CUT
    return asked(s, True) if x.no == last.no else (False, None, _sentence_like(s)[1] if _sentence_like(s)[0] else None, False)


def _closed_later(raws: list[str]) -> bool:
    """Whether prose follows the last fence, so that it closed a block whose start is missing."""
    at = max(i for i, raw in enumerate(raws) if raw.lstrip().startswith("```"))
    return any(_FULL.search(raw.rstrip()) and len(raw) > 60 for raw in raws[at + 1 :])


def _broken_furniture(text: str, brand: str) -> bool:
    if full(text):
        return False
    parts = [p for p in re.split(r" +[|·/•] +| {2,}", text) if p]
    if len(parts) > 1 and all(p in ITEMS or p.lower() == brand for p in parts[:-1]):
        return parts[-1] not in ITEMS and parts[-1].lower() != brand
    return text not in ITEMS and _cut_short(text, brand, NONE)


def _counted(values: DataFrame) -> DataFrame:
    """(kind, a, b, c, n, bits): counts of lengths (field and source, measure and ending, length), beginnings and words.

    values: (field, source, text). bits: map of 63 hash buckets of the last characters at that length. Partial sums leave each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])

        def emit():
            keys = list(counts)
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(x, pa.int64()) for x in ([k[3] for k in keys], [v[0] for v in counts.values()], [v[1] for v in counts.values()])]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "c", "n", "bits"])

        for batch in batches:
            for name, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text or not text.strip():
                    continue
                s = bare(text) if name == "snippet" else plain(text)
                end = s if name == "snippet" else s.rsplit("\n", 1)[-1]
                kind = ending(end)
                if kind != "full":
                    held_text = unmarked(s)
                    where, bit = f"{name}\t{source or ''}", 1 << zlib.crc32(held_text[-8:].encode("utf-8", "surrogatepass")) % 63
                    for measure, n in zip(MEASURES, lengths(held_text)):
                        held = counts["length", where, f"{measure}\t{kind}", n]
                        held[0] += 1
                        held[1] |= bit
                for line in (text.split("\n") if name == "content" else (s,)):
                    line = line.strip()
                    if not line:
                        continue
                    whole = full(line)
                    unended = not whole and not marked(line)
                    if line[0] not in "<[-*#{}" and len(line) > 8 and (whole or unended):
                        counts["beginning", beginning(line), "", int(whole or inner(line))][0] += 1
                    if unended:
                        seen = (line if line[0] != "<" else _TAGS.sub("", line)).rstrip()
                        found = _LETTERS.findall(seen.lower())
                        for word in found:
                            counts["word", word, "", 1][0] += 1
                        if found and seen[-1:].isalpha():  # the last word may be cut
                            counts["word", found[-1], "", 1][0] -= 1
                            counts["word", found[-1], "", 0][0] += 1
            if len(counts) > 200_000:
                yield emit()
        yield emit()

    partial = values.mapInArrow(run, "kind string, a string, b string, c long, n long, bits long")
    return partial.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))


def find_limits(counts: DataFrame) -> DataFrame:
    """(a, b, c, slack, mass): of each source (a), measure and ending (b) the limit c, if there is one.

    counts: (a, b, c, n, bits), a row for each length c. Values end in [c - slack, c]; mass of them do. c is the
    least length with next to nothing beyond.
    """
    by = Window.partitionBy("a", "b").orderBy("c")
    within = {w: F.sum("n").over(by.rangeBetween(-w, 0)) for w in SLACKS}
    widest = SLACKS[-1]
    before = F.coalesce(F.sum("n").over(by.rangeBetween(-widest - 50, -widest - 1)), F.lit(0)) / 50
    beyond = F.sum("n").over(Window.partitionBy("a", "b")) - F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, 0))
    marked = counts.withColumns({**{f"w{w}": m for w, m in within.items()}, "before": before, "beyond": beyond, "varied": F.bit_count(F.bit_or("bits").over(by.rangeBetween(-widest, 0)))})
    pile = F.col(f"w{widest}")
    found = marked.where((pile >= PILE) & (F.col("varied") >= VARIED) & (F.col("beyond") <= BEYOND * pile) & (pile >= TIMES * (widest + 1) * F.col("before")))
    slack = F.coalesce(*(F.when(F.col(f"w{w}") >= HELD * pile, F.lit(w)) for w in SLACKS))
    rows = found.withColumns({"slack": slack, "mass": F.coalesce(*(F.when(F.col(f"w{w}") >= HELD * pile, F.col(f"w{w}")) for w in SLACKS))})
    return rows.groupBy("a", "b").agg(F.min_by(F.struct("c", "slack", "mass"), "c").alias("r")).select("a", "b", "r.*")


def limits_of(counts: DataFrame) -> DataFrame:
    """(field, source, ending, measure, length, slack, mass): of each source and ending the measure that shows a limit best.

    That is the one with most values within its slack, then the least slack, then the first of MEASURES.
    """
    part = lambda c, i: F.split(c, "\t")[i]
    each = find_limits(counts.where("kind = 'length'")).select(part("a", 0).alias("field"), part("a", 1).alias("source"), part("b", 1).alias("ending"), part("b", 0).alias("measure"), F.col("c").alias("length"), "slack", "mass")
    rank = F.struct(F.col("mass"), -F.col("slack"), -F.array_position(F.array(*map(F.lit, MEASURES)), F.col("measure")))
    return each.groupBy("field", "source", "ending").agg(F.max_by(F.struct("measure", "length", "slack", "mass"), rank).alias("r")).select("field", "source", "ending", "r.*")


def fragments(counts: DataFrame) -> DataFrame:
    """(word): last words of lines that are the start of a longer word in use, and no word themselves."""
    words = counts.where("kind = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("uses"), F.sum(F.col("n") * F.col("c")).alias("inner"))
    starts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))
    longer = words.where((F.col("inner") >= USED) & (F.length("word") > 1)).select(F.explode(starts).alias("start"), "inner").groupBy("start").agg(F.max("inner").alias("longer"))
    last = words.where("uses > inner")
    return last.join(longer, F.col("word") == F.col("start")).where(F.col("uses") < FRAGMENT_SHARE * F.col("longer")).select("word")


def sentence_starts(counts: DataFrame) -> DataFrame:
    """(start, sentence): beginnings seen SEEN times, and whether most of their lines are sentences."""
    n = counts.where("kind = 'beginning'").groupBy(F.col("a").alias("start")).agg(F.sum(F.col("n") * F.col("c")).alias("whole"), F.sum("n").alias("n"))
    return n.where(F.col("n") >= SEEN).select("start", (F.col("whole") >= 0.5 * F.col("n")).alias("sentence"))


def _values(hits: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, row_id, source, text) of snippets, and with (title, host, layer, content) of pages; sources in one spelling."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    a = hits.select(F.lit("snippet").alias("field"), F.col("hit_id").cast("long").alias("row_id"), name("module").alias("source"), F.col("snippet").alias("text"))
    b = pages.select(F.lit("content").alias("field"), F.col("content_id").cast("long").alias("row_id"), name("layer_used").alias("source"), "content", "title", url_host(F.col("url")).alias("host"), F.col("layer_used").alias("layer"))
    return spread(a), spread(b)


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    texts = a.select("field", "source", "text").unionByName(b.select("field", "source", F.col("content").alias("text")))
    return written(_counted(texts), "truncation-counts")


def _collected(found: DataFrame) -> Limits:
    return {(r.field, r.source, r.ending): (MEASURES.index(r.measure), r.length, r.slack) for r in found.collect()}  # a row for each source and ending


ASKED = "field string, row_id long, source string, cut boolean, word string, start string, unknown boolean"


def find_cut(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(field, row_id, source): snippets of hits and texts of pages that lost their end.

    hits: (hit_id, module, snippet); pages: (content_id, layer_used, content, title, url). Null, empty and blank values
    have lost nothing that can be told. Null sources are judged as one source. Other columns play no part. The
    counts over all values are made while this is called.
    """
    a, b = _values(hits, pages)
    counts = _counts(a, b)
    joined, templates = with_templates(b)
    held = hits.sparkSession.sparkContext.broadcast(_collected(limits_of(counts)))

    def emitted(batch: pa.RecordBatch, said: list[tuple]) -> pa.RecordBatch:
        at = [i for i, v in enumerate(said) if v[0] or v[1] is not None or v[2] is not None or v[3]]
        took, kept = pa.array(at, pa.int64()), [said[i] for i in at]
        kinds = (pa.bool_(), pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in range(3)), *(pa.array([v[i] for v in kept], t) for i, t in enumerate(kinds))], names=["field", "row_id", "source", "cut", "word", "start", "unknown"])

    def of_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emitted(batch, [snippet_cut(text, source, held.value) for source, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(2, 8)))
            yield emitted(batch, [content_cut(content, source, title, host, held.value, templates.value.of(host, layer, lines)) for source, content, title, host, layer, lines in rows])

    said = a.mapInArrow(of_snippets, ASKED).unionByName(joined.select("field", "row_id", "source", "content", "title", "host", "layer", "lines").mapInArrow(of_pages, ASKED))
    told = written(said, "truncation-asked")
    # values alone cannot tell whether a word is a fragment; few are left to ask
    asks = told.where("NOT cut").join(fragments(counts).withColumn("fragment", F.lit(True)), "word", "left").join(sentence_starts(counts), "start", "left")
    late = asks.where(F.coalesce("fragment", F.lit(False)) | F.coalesce("sentence", "unknown"))
    return told.where("cut").select("field", "row_id", "source").unionByName(late.select("field", "row_id", "source"))


def cut_rates(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(field, source, texts, cut, share): how often each module and layer cuts, of its values that aren't empty."""
    found = find_cut(hits, pages).groupBy("field", "source").agg(F.count("*").alias("cut")).withColumnsRenamed({"field": "f", "source": "s"})
    a, b = _values(hits, pages)
    values = a.select("field", "source", "text").unionByName(b.select("field", "source", F.col("content").alias("text")))
    total = values.where("trim(text) <> ''").groupBy("field", "source").agg(F.count("*").alias("texts"))
    joined = total.join(found, (F.col("field") == F.col("f")) & F.col("source").eqNullSafe(F.col("s")), "left")
    cut = F.coalesce("cut", F.lit(0))
    return joined.select("field", "source", "texts", cut.alias("cut"), (cut / F.col("texts")).alias("share"))


def storage_limits(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(field, source, ending, measure, length, slack, mass): the limits at which values of a source pile up, in the measure that shows each best."""
    return limits_of(_counts(*_values(hits, pages)))
