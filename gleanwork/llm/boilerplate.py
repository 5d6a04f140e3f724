"""Page furniture among the lines of cached pages, and the main body without it, by tag-path ratios.

Each line is a node with a path from the root to its leaf: the elements open around it in HTML, headings, list marks and
links in Markdown, and at the end the leaf's shape (one that ends as a sentence, an open one, a row of items).
Text length, sentence ends, linked text and leaves are summed by path over the page, and over all pages of a layer on
Spark; both sums are fused into one ratio for each path. A line's content value joins that ratio with
the line's own, is smoothed over neighbouring lines, and lines under the threshold are the ones that may be furniture. So
the ratios lay out each page: its first and last content line, and what stands outside.

Where lines recur is counted with the same layout: a line that a host repeats over pages of distinct texts, and a line
that stands outside the content on many hosts. Below the threshold, a line is furniture if it recurs so, if its path is
of links, if it is a row of items, or if words of furniture give a weak vote and nothing speaks against it.
Headings, lists and code of an article are low as well, so nothing is furniture by a low value alone unless
it stands in a block of furniture outside the content.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm import furniture_words as W
from gleanwork.llm import residue_words, truncation_words
from gleanwork.llm.bounded import small_enough
from gleanwork.llm.caps import url_host
from gleanwork.llm.mojibake import _ANY_LEAD, _CJK, _REPLACED, CJK_READ, shifted, to_bytes, undone
from gleanwork.session import spread, written

#: Content values of 0 to about 6: a line under LOW may be furniture, one of HIGH or more is content whatever stands around it.
LOW, HIGH = 2.0, 4.0
#: Leaves of its layer that a path of a page counts besides its own.
LAYER_LEAVES = 2.0
#: Weights of a line itself and of each neighbour in the smoothed value.
SMOOTH_SELF, SMOOTH_NEXT = 0.8, 0.1
#: What shifts the threshold for a line: words of furniture, a line known on all hosts (or worded with the host's name outside the content), one that its host repeats.
WORDED, KNOWN, REPEATED = 0.6, 2.0, 4.0
#: A line counts as repeated by its host if it stands on this share of its pages and on so many of them.
REPEATED_SHARE, REPEATED_PAGES = 0.3, 8
#: On fewer pages, on three at least, the lower bound of its share (two deviations) must reach this.
SURE_SHARE, SURE_PAGES = 0.2, 3
#: A line is known on all hosts if it stands on so many of them and this share of all pages, which bounds how many are known, and
#: if on the next share of its pages, a sentence on the last, it stands outside the content.
KNOWN_HOSTS, KNOWN_SHARE, KNOWN_OUTSIDE, KNOWN_SENTENCE = 3, 2e-4, 0.6, 0.9
#: Lines of more characters are counted by the first HEAD_CHARS and a hash of the whole.
KEY_CHARS, HEAD_CHARS = 96, 32
#: Before the key of an item of a list, as words of lists recur by topic and need REPEATED_SHARE for sure.
_ITEM = "\x01"
#: In place of the host's own name in a key.
_BRAND = "\x02"

_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?")
_CLASS = re.compile(r"""class=["']?([\w -]+)""")
#: Elements without an end, and those that a next one of their kind ends.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NO_NEST = frozenset("p li td th tr dt dd option h1 h2 h3 h4 h5 h6".split())
_MD_LINK = re.compile(r"([*+-] )?\[(.*)\]\([^()\s]*\)?$")
_BULLET = re.compile(r"(#{1,6}|[-*+•]|\d+[.)]) +")
_SEPARATED = re.compile(r" +[|·/•>»›] +| {2,}")
_BAR = re.compile(r" +[|·/•] +| {2,}")
_CRUMBS = re.compile(r" +[>»›/] +")
_ENDED = re.compile(r"[.!?。！？…:]['\"”’»」）)\]]*$")
#: The last characters of what _ENDED matches: marks, and what may follow them.
_MARKS, _CLOSERS = frozenset(".!?。！？…:"), frozenset("'\"”’»」）)]\n")
#: Runs are written as one and more, as patterns that begin with a set are searched for faster.
_DIGITS = re.compile(r"\d\d*")
#: Lower case and 0 for any digit, for ASCII.
_ASCII_MASK = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
#: A character that _SEPARATED, _BAR or _CRUMBS need if there are no two spaces.
_SEPARATOR = re.compile("[|·/•>»›]")
#: Code by how a line begins and by a call; what else shows code is found without a pattern.
_CODE_START = re.compile(r"\s{2,}\S|\t|[a-z_.-]+:( \S+)?$|(return|SELECT|WHERE|FROM|import|def|func|if)\b|\$ |error: ")
_CALL = re.compile(r"\w\(")


def _runs(chars: str) -> re.Pattern:
    return re.compile(f"{chars}{chars}*")


_WIDE = _runs("[぀-ヿ㐀-鿿가-힯]")
#: The most frequent characters of Chinese and Japanese texts.
_FREQUENT = _runs("[的一是不了在有和与这为以我用中大人之のはをにがでとたてるしいなれら]")


def masked_key(text: str, brand: str = "") -> str:
    """text in lower case with 0 for any number and a mark for the host's name; of a long one the beginning and a hash of the whole."""
    m = _branded_mask(text, brand)
    return m if len(m) <= KEY_CHARS else _shortened(m)


def _branded_mask(text: str, brand: str) -> str:
    m = _masked(text) if len(text) < 120 else _masked.__wrapped__(text)
    return m.replace(brand, _BRAND) if brand and brand in m else m


def _shortened(masked: str) -> str:
    return f"{masked[:HEAD_CHARS]}\0{blake2b(masked.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


@lru_cache(50_000)
def _masked(text: str) -> str:
    """text in lower case with 0 for any number."""
    if not text.isascii():
        return _DIGITS.sub("0", text.lower())
    m = text.encode().translate(_ASCII_MASK)
    while b"00" in m:
        m = m.replace(b"00", b"0")
    return m.decode()


def _split(groups: dict[str, str]) -> set[str]:
    return {x.strip() for words in groups.values() for x in words.split(",")}


ITEMS, SIDEBARS, HOMES = _split(W.ITEMS), _split(W.SIDEBARS), _split({"": W.HOMES})
_SHAPES = re.compile("|".join(W.SHAPES), re.I)
#: What is residue or a mark of a cut, and so no furniture.
class _Phrases:
    """Whether a text in lower case holds one of some phrases."""

    def __init__(self, phrases: list[str]):
        self.automaton = ahocorasick.Automaton()
        for x in phrases:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()

    def search(self, text: str) -> str | None:
        return next(self.automaton.iter(text), (0, None))[1]


_CUES = _Phrases([x.strip() for x in W.CUES.split(",")])
_NOTICE = _Phrases([x for x in (residue_words.NOTICES + residue_words.FILLERS).strip().split("\n") if x])
_NOTICE_SHAPES = residue_words.NOTICE_SHAPES + residue_words.NEUTRAL_SHAPES + residue_words.FILLER_SHAPES
#: Shapes that begin with the line, and those that need not, which all have _ANYWHERE_CUE.
_NOTICE_START = re.compile("|".join(x for x in _NOTICE_SHAPES if x[0] == "^"), re.I)
_NOTICE_ANYWHERE, _ANYWHERE_CUE = re.compile("|".join(x for x in _NOTICE_SHAPES if x[0] != "^"), re.I), "nan"
#: The placeholder pattern, and a character that each of its forms has.
_PLACEHOLDER, _PLACEHOLDER_CUE = re.compile(residue_words.PLACEHOLDER), re.compile(r"[{%_@*\[]")
_PROMPTS = frozenset(truncation_words.PROMPTS + truncation_words.NOTES)


def _held(runs: re.Pattern, text: str) -> int:
    """Characters of text that stand in runs."""
    return sum(map(len, runs.findall(text)))


def _may_be_garbled(text: str) -> bool:
    """Whether a line has signs of a wrong decoding: lead bytes as letters, shifted case, or hardly a common character of an unspaced script."""
    if _ANY_LEAD.search(text) or shifted(text):
        return True
    wide = _held(_WIDE, text)
    return wide > 0 and 12 * _held(_FREQUENT, text) < wide or _REPLACED in text


@lru_cache(20_000)
def repaired(text: str) -> tuple[str, ...]:
    """What a line may have been before wrong decodings, for matching only; nothing where it has no signs of one."""
    if not _may_be_garbled(text):
        return ()
    once = [t for _, t in undone(text, shifted(text))]
    if _CJK.search(text):
        for read in CJK_READ:  # a last character may be lost
            if (raw := to_bytes(text.replace("�", ""), read)) and (t := raw.decode("utf-8", "ignore")) and 3 * len(t) > len(text):
                once.append(t)
    return tuple(once + [t for o in once if not o.isascii() for _, t in undone(o, False)])


def _shape(text: str) -> tuple[int, bool, int, float]:
    """(size, whether it ends as a sentence, leaves, its own ratio) of the text of a line."""
    end = text[-1:]
    ended = end in _MARKS or end in _CLOSERS and _ENDED.search(text, max(len(text) - 8, 0)) is not None
    leaves = 1 + len(_SEPARATED.findall(text)) if "  " in text or not ended and " " in text and _SEPARATOR.search(text) else 1
    size = weight(text)
    return size, ended, leaves, ratio(size, ended, 0.0, leaves) if size else 0.0


def _code(raw: str) -> bool:
    """Whether a line looks like code."""
    return "{" in raw or "}" in raw or "\\" in raw or " = " in raw or raw[-1:] == ";" or _CODE_START.match(raw) is not None or "(" in raw and _CALL.search(raw) is not None


def _ending(ended: bool, leaves: int) -> str:
    """The end of a path: the leaf's shape."""
    return "/." if ended else "/|" if leaves > 1 else "/~"


@lru_cache(50_000)
def _read_plain(raw: str) -> tuple[str, str, str, bool, int, bool, int, float]:
    """(mark, text, path, whether linked, then its shape) of a line that is no element."""
    s = raw.strip()
    if m := _MD_LINK.match(s):
        mark, text, path, link = (m[1] or "").strip(), m[2].strip(), f"{(m[1] or '').strip()}/[]", True
    elif m := _BULLET.match(s):
        mark = m[1][0] if not m[1][0].isdigit() else "1"
        text, path, link = s[m.end() :].strip(), m[1] if mark == "#" else mark, False
    else:
        mark = "code" if len(s) < 200 and _code(raw) else ""
        text, path, link = s, mark, False
    size, ended, leaves, own = _shape(text)
    return mark, text, path + _ending(ended, leaves), link, size, ended, leaves, own


@lru_cache(20_000)
def _read_element(s: str, open_tags: tuple[str, ...]) -> tuple[str, str, str, bool, int, bool, int, float, list[str]]:
    """_read_plain of a line that begins with an element, and the elements that are open after it."""
    after = list(open_tags)
    mark, text, path, link = Line._element(s, after)
    size, ended, leaves, own = _shape(text)
    return mark, text, path + _ending(ended, leaves), link, size, ended, leaves, own, after


class Line:
    """A non-blank line: its text without marks, root-to-leaf path, leaves, whether it is linked, ended, in a fenced block."""

    __slots__ = ("no", "raw", "text", "path", "mark", "link", "ended", "leaves", "fenced", "kind", "value", "repeated", "size", "own")

    def __init__(self, no: int, raw: str, open_tags: list[str]):
        self.no, self.raw, self.fenced, self.kind, self.value, self.repeated = no, raw, False, "", 0.0, False
        if "<" in raw and (s := raw.strip())[0] == "<" and _TAG.match(s):
            self.mark, self.text, self.path, self.link, self.size, self.ended, self.leaves, self.own, open_tags[:] = (_read_element if len(s) < 120 else _read_element.__wrapped__)(s, tuple(open_tags))
        else:
            self.mark, self.text, self.path, self.link, self.size, self.ended, self.leaves, self.own = _read_plain(raw) if len(raw) < 120 else _read_plain.__wrapped__(raw)
            if open_tags and len(self.path) == 2:  # nothing but the leaf's shape
                self.path = "/".join((*open_tags, self.mark)) + self.path

    @staticmethod
    def _element(s: str, open_tags: list[str]) -> tuple[str, str, str, bool]:
        """(own element, text, path of the longest text, whether most of the text is linked); open_tags changes with the line."""
        texts, at, linked, total, best, path, first = [], 0, 0, 0, -1, "", ""

        def take(part: str) -> None:
            nonlocal linked, total, best, path
            if part.strip():
                texts.append(part)
                n = len(part.strip())
                total += n
                linked += n if "a" in open_tags else 0
                if n > best:
                    best, path = n, "/".join(open_tags)

        for m in _TAG.finditer(s):
            take(s[at : m.start()])
            at = m.end()
            name = m[2].lower()
            if m[1]:
                if name in (t.split(".")[0] for t in open_tags):
                    while open_tags.pop().split(".")[0] != name:
                        pass
            elif name not in _VOID and not m[3].endswith("/"):
                c = _CLASS.search(m[3]) if m[3] else None
                if name in _NO_NEST and open_tags and open_tags[-1].split(".")[0] == name:
                    open_tags.pop()
                open_tags.append(f"{name}.{c[1].strip()}" if c and name != "a" else name)
                first = first or open_tags[-1]
        take(s[at:])
        if "a" in open_tags:  # an anchor ends with its line
            del open_tags[open_tags.index("a") :]
        return first.split(".")[0], "".join(texts).strip(), path, bool(total) and linked >= 0.8 * total

    def item(self) -> bool:
        return self.mark in ("-", "*", "+", "1", "li")

    def prefix(self) -> str:
        return _ITEM if self.item() and not self.link else ""

    def key(self, brand: str) -> str:
        key = masked_key(self.text, brand)
        return _ITEM + key if not self.link and self.item() else key


def read_lines(content: str) -> list[Line]:
    """The non-blank lines, numbered from 1 over all lines; lines of a fenced block have the mark `code`."""
    out, fenced, open_tags = [], False, []
    for no, raw in enumerate(content.split("\n"), 1):
        if not raw or raw.isspace():
            continue
        line = Line(no, raw, [] if fenced else open_tags)
        fence = "```" in raw and raw.lstrip().startswith("```")
        if fence or fenced:
            line.fenced = not fence
            line.mark, line.path = "code", "code"
            fenced = fenced != fence
        out.append(line)
    return out


def weight(text: str) -> int:
    """Length of a text; a character of an unspaced script counts as two."""
    return len(text) if text.isascii() else len(text) + _held(_WIDE, text)


def path_sums(lines: list[Line]) -> dict[str, list[float]]:
    """Text length, sentence ends, linked text and leaves of each path."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for line in lines:
        r, n = sums[line.path], line.size
        r[0] += n
        r[1] += line.ended
        r[2] += n * line.link
        r[3] += line.leaves
    return sums


def ratio(chars: float, ends: float, linked: float, leaves: float) -> float:
    """Content value of text: the log of its length per leaf, less without sentence ends, none if it is linked."""
    return math.log1p(chars / leaves) * (0.3 + 0.7 * min(ends / leaves, 1.0)) * (1 - linked / max(chars, 1.0))


def _unsmoothed(lines: list[Line], layer: dict[str, list[float]], paths: dict[str, list[float]]) -> list[float]:
    """The ratio of each line's path on the page and in its layer with the line's own; paths: path_sums of lines."""
    fused = {}
    for path, sums in paths.items():
        wide = layer.get(path)
        if wide and wide[3]:
            sums = [x + LAYER_LEAVES * y / wide[3] for x, y in zip(sums, wide)]
        fused[path] = ratio(*sums)
    return [((0.0 if line.link else line.own) + fused[line.path]) / 2 for line in lines]


def valued(lines: list[Line], layer: dict[str, list[float]]) -> None:
    """Sets the value of each line: the ratio of its path on the page and in its layer with its own, smoothed over its neighbours."""
    raw = _unsmoothed(lines, layer, path_sums(lines))
    for line, before, own, after in zip(lines, [*raw[:1], *raw], raw, [*raw[1:], *raw[-1:]]):
        line.value = SMOOTH_SELF * own + SMOOTH_NEXT * (before + after)
        if own >= HIGH and line.value < LOW:
            line.value = LOW


def core(lines: list[Line]) -> tuple[int, int]:
    """Places of the first and last line of content by value; (len, -1) if there is none."""
    high = [i for i, line in enumerate(lines) if line.value >= HIGH]
    return (high[0], high[-1]) if high else (len(lines), -1)


def _core_alone(lines: list[Line], paths: dict[str, list[float]]) -> tuple[int, int]:
    """core of a page without its layer, of which no other values are needed; paths: path_sums of lines."""
    raw = _unsmoothed(lines, {}, paths)
    last = len(raw) - 1
    high = lambda i: SMOOTH_SELF * raw[i] + SMOOTH_NEXT * (raw[max(i - 1, 0)] + raw[min(i + 1, last)]) >= HIGH
    first = next((i for i in range(last + 1) if high(i)), None)
    return (last + 1, -1) if first is None else (first, next(i for i in range(last, -1, -1) if high(i)))


def brand_of(host: str | None) -> str:
    labels = (host or "").split(".")
    return labels[-2] if len(labels) > 1 else labels[0]


@lru_cache(100_000)
def _barred(text: str) -> bool:
    """Whether a line is no furniture whatever else it looks like: without letters, residue, or a mark of a cut."""
    if not text[:1].isalpha() and not any(c.isalpha() for c in text) or text in _PROMPTS:
        return True
    if _PLACEHOLDER_CUE.search(text) and _PLACEHOLDER.search(text):
        return True
    lower = text.lower()
    return _NOTICE.search(lower) is not None or _NOTICE_START.match(text) is not None or _ANYWHERE_CUE in lower and _NOTICE_ANYWHERE.search(text) is not None


def _worded(text: str, brand: str) -> str:
    """`side`, `yes` or empty: the vote of the words of a line alone."""
    for word, row in _wording(text):
        if word or _row(row, brand):
            return word or "yes"
    return ""


@lru_cache(100_000)
def _wording(text: str) -> tuple[tuple[str, str], ...]:
    """(vote, empty) or (empty, what may be a row) of a line and its readings, to the first vote."""
    found = []
    for t in (text, *(() if text.isascii() else repaired(text))):
        if t in SIDEBARS:
            return *found, ("side", "")
        if t in ITEMS or _CUES.search(t.lower()) and _SHAPES.search(t):
            return *found, ("yes", "")
        if "  " in t or _SEPARATOR.search(t):
            found.append(("", t))
    return tuple(found)


def _row(text: str, brand: str) -> bool:
    """A row of navigation items or a breadcrumb by its words."""
    if "  " not in text and not _SEPARATOR.search(text):
        return False
    crumbs = _CRUMBS.split(text)
    if len(crumbs) >= 2 and crumbs[0] in HOMES:
        return True
    parts = [p for p in _BAR.split(text) if p]
    if len(parts) < 2:
        return False
    known = [p in ITEMS or p.lower() == brand for p in parts]
    return sum(known) >= 0.6 * len(parts) and any(p in ITEMS for p in parts)


class Lines:
    """Keys of lines, and whether one of them starts with a text."""

    def __init__(self, keys=()):
        self.ordered = sorted(keys)
        self.keys = frozenset(self.ordered)
        texts = [key[at:] for key in self.ordered for at in range(1 + key.startswith(_ITEM))]
        #: How long lines begin, as others need no hash to be looked up, and the first two characters of all.
        self.heads = frozenset(t[:HEAD_CHARS] for t in texts if "\0" in t)
        self.firsts = frozenset(t[:2] for t in texts)

    def __contains__(self, key: str) -> bool:
        return key in self.keys

    def holds(self, prefix: str, masked: str) -> bool:
        """Whether the key of a masked text is one of them."""
        if len(masked) <= KEY_CHARS:
            return prefix + masked in self.keys
        return masked[:HEAD_CHARS] in self.heads and prefix + _shortened(masked) in self.keys

    def may_hold(self, text: str, brand: str) -> bool:
        """Whether the key of a text may be one of them, by its first letters if they are ASCII and no part of the host's name."""
        first = text[:2]
        return not (first.isascii() and first.isalpha()) or (low := first.lower()) in self.firsts or brand[:1] in low and brand != ""

    def starting(self, head: str) -> bool:
        """Whether a key other than head starts with it; of a long key, with its first characters."""
        long = head[:HEAD_CHARS] + "\0"
        i = bisect_left(self.ordered, long)
        if len(head) >= HEAD_CHARS and i < len(self.ordered) and self.ordered[i].startswith(long):
            return "\0" not in head
        return self.beginning(head)


    def beginning(self, text: str) -> bool:
        """Whether a key other than text starts with it; keys are short."""
        i = bisect_right(self.ordered, text)
        return i < len(self.ordered) and self.ordered[i].startswith(text)


NONE, _FIXED = Lines(), Lines(ITEMS | SIDEBARS)


def _cut_short(text: str, brand: str, repeated: Lines, known: Lines = NONE) -> bool:
    """The start of a furniture line whose end is lost."""
    parts = [p for p in _BAR.split(text) if p]
    if len(parts) >= 2 and all(p in ITEMS or p.lower() == brand for p in parts[:-1]):
        return True
    if len(text) < 3:
        return False
    key = masked_key(text, brand)
    heads = [key]
    if stem := max((n for n in range(1, len(brand)) if key.endswith(brand[:n])), default=0):
        heads.append(key[:-stem] + _BRAND)  # the host's name itself was cut
    if any(of.starting(h) for of in (repeated, known) for h in heads):
        return True
    return len(heads) > 1 and (heads[1] in repeated or heads[1] in known) or _FIXED.beginning(text)


def furniture_lines(content: str, title: str | None, host: str | None, repeated: Lines = NONE, known: Lines = NONE, layer: dict[str, list[float]] | None = None, lines: list[Line] | None = None) -> list[int]:
    """Numbers of the furniture lines of a page.

    repeated: lines that the host repeats; known: those known on all hosts; layer: the sums of each path over all pages
    of the layer; lines: those of content, if they were read before.
    """
    lines = read_lines(content) if lines is None else lines
    brand = brand_of(host)
    own = (title or "").strip()
    owns = {own, *(() if own.isascii() else repaired(own))} - {""}
    valued(lines, layer or {})
    first, last = core(lines)
    for i, line in enumerate(lines):
        text = line.text
        votes, word, barred, repeats = 0.0, "", False, False
        if text and line.value < LOW + WORDED + REPEATED and (line.mark != "code" or line.fenced and not _code(line.raw)):
            prefix, below = line.prefix(), line.value < LOW + WORDED + KNOWN  # above, only what the host repeats can be low
            masked = [_branded_mask(text, brand)] if below or repeated.may_hold(text, brand) else []
            repeats = masked != [] and repeated.holds(prefix, masked[0])
            if not repeats and not text.isascii() and (readings := repaired(text)):
                masked += [_branded_mask(t, brand) for t in readings]
                repeats = any(repeated.holds(prefix, m) for m in masked)
            if repeats or below:
                edge = not first < i < last
                votes = REPEATED if repeats else KNOWN if edge and any(known.holds(prefix, m) for m in masked) else 0.0
                own_name = KNOWN if edge and _branded(text, brand) else 0.0
                if line.value < LOW + WORDED + max(votes, own_name):  # words and what bars a line can decide
                    barred = _barred(text)
                    word = "" if barred else _worded(text, brand)
                    votes = 0.0 if barred else max(votes, own_name) + WORDED if word else votes
        low = line.value < LOW + votes
        recurs, word = low and votes >= (REPEATED if line.fenced else KNOWN), word if low else ""
        line.repeated = recurs and repeats
        if text in owns or owns and not word and not recurs and not text.isascii() and not owns.isdisjoint(repaired(text)) or line.mark in ("#", "h1") and i < first and line.path[:2] in ("#/", "h1") and not recurs:
            line.kind = "own"
        elif word == "side":
            line.kind = "side"
        elif recurs:
            line.kind = "told" if line.ended else "yes"
        elif word:
            line.kind = "yes"
        elif low and line.link:
            line.kind = "link"
        elif not low or line.mark == "code":
            line.kind = "no"
        else:
            line.kind = "no" if barred and text else "?"
    bodied = any(line.kind in ("no", "?") for line in lines)
    for line in lines:
        if line.kind == "told":  # a page of nothing but repeated lines keeps its sentences
            line.kind = "yes" if bodied else "no"
    side = None  # path of the open block of links to other pages
    body = False
    for line in lines:
        if side is not None and body and line.kind == "own":
            line.kind = "link"  # the page itself among the links below its body
        body = body or line.kind in ("no", "own")
        if line.kind == "side":
            side, line.kind = "", "yes"
        elif side is not None and line.kind in ("?", "link") and side in ("", line.mark + "!"):
            side, line.kind = line.mark + "!", "yes"
        elif side is not None and line.kind == "yes" and not line.repeated and line.leaves == 1 and line.text not in ITEMS:
            pass  # a link to another page that is known from others
        else:
            side = None
            if line.kind == "link":  # links of a list within the body belong to it
                line.kind = "?" if body and line.item() else "yes"
    if side and lines[-1].kind == "yes" and not lines[-1].link and not any(line.kind == "no" for line in lines) and len(lines[-1].text) > 12:
        lines[-1].kind = "?"  # a page ends in its body, if it was cut within its first sentence
    firm = [i for i, line in enumerate(lines) if line.kind in ("no", "own")]
    first, last = (firm[0], firm[-1]) if firm else (len(lines), -1)
    for i, line in enumerate(lines):  # outside the content, an open line between furniture is furniture
        if line.kind == "?" and not first < i < last and not line.item() and line.mark[:1] not in ("#", "h"):
            near = [lines[j].kind for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            if near.count("yes") == 2 or near == ["yes"] and _branded(line.text, brand):  # at an edge of the page, if it names its house
                line.kind = "yes"
    if lines and lines[-1].kind in ("?", "no") and lines[-1].mark != "code":
        end = lines[-1]
        if _cut_short(end.text, brand, repeated, known) and (len(lines) > 1 and lines[-2].kind == "yes" or len(end.text) > 12):
            end.kind = "yes"
    return [line.no for line in lines if line.kind == "yes"]


def _branded(text: str, brand: str) -> bool:
    return len(brand) > 2 and brand in text.lower()


def _distinct(n: str, a: str, b: str) -> Column:
    """n, or the number of distinct texts that two maps of 63 hash buckets show, if that is less."""
    held = F.greatest(F.bit_count(a), F.bit_count(b))
    return F.when(held < 63, F.least(F.col(n).cast("double"), F.ceil(-63 * F.log(1 - held / 63) - 0.5).cast("double"))).otherwise(F.col(n).cast("double"))


def _counted(pages: DataFrame) -> DataFrame:
    """(host, layer, line, n, a, b, outside, chars, ends, linked): sums of lines by host, and of paths by layer (host null).

    pages: (host, layer, content). Every line of every page is counted once a page, in each task before the shuffle.
    """
    names = ["host", "layer", "line", "n", "a", "b", "outside", "chars", "ends", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_hosts: dict[str, dict[str, tuple[int, ...]]] = defaultdict(dict)
        of_paths: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
        held = 0

        def emit():
            nonlocal held
            hosts = [host for host, of_lines in of_hosts.items() for _ in of_lines]
            ks, vs = [s for of_lines in of_hosts.values() for s in of_lines], [v for of_lines in of_hosts.values() for v in of_lines.values()]
            n, m, ps, ws = len(ks), len(of_paths), list(of_paths), list(of_paths.values())
            text = lambda xs: pa.array(xs, pa.string())
            longs = [pa.array([v[i] for v in vs] + ([int(w[3]) for w in ws] if i == 0 else [0] * m), pa.int64()) for i in range(4)]
            reals = [pa.array([0.0] * n + [w[i] for w in ws]) for i in range(3)]
            columns = [text(hosts + [None] * m), text([None] * n + [p[0] for p in ps]), text(ks + [p[1] for p in ps]), *longs, *reals]
            of_hosts.clear(), of_paths.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for host, layer, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not content:
                    continue
                lines, brand = read_lines(content), brand_of(host)
                paths = path_sums(lines)
                for path, sums in paths.items():
                    total = of_paths[layer or "", path]
                    for i in range(4):
                        total[i] += sums[i]
                first, last = _core_alone(lines, paths)
                text = int.from_bytes(blake2b(content.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                a, b = 1 << text % 63, 1 << (text >> 32) % 63
                seen = {"": 0}
                for i, x in enumerate(lines):
                    if x.mark != "code" and len(x.text) > 2 and (key := x.key(brand)) not in seen:
                        seen[key] = 0 if first < i < last else 1
                of_lines, once = of_hosts[host or ""], ((1, a, b, 0), (1, a, b, 1))
                held -= len(of_lines)
                for s, outside in seen.items():
                    counts = of_lines.setdefault(s, once[outside])
                    if counts is not once[outside]:
                        of_lines[s] = counts[0] + 1, counts[1] | a, counts[2] | b, counts[3] + outside
                held += len(of_lines)
            if held > 200_000:
                yield emit()
        yield emit()

    return pages.select("host", "layer", "content").mapInArrow(run, "host string, layer string, line string, n long, a long, b long, outside long, chars double, ends double, linked double")


class Templates:
    """What the counts of all pages tell about one: lines of its host, lines known on all hosts, path sums of its layer.

    hosts is null where the templates of all hosts are too large to send to each task; they come with the rows then.
    """

    def __init__(self, hosts: dict[str, list[str]] | None, known: list[str], layers: dict[str, dict[str, list[float]]]):
        self.hosts, self.known, self.layers = hosts, known, layers
        self.read: dict[str, Lines] = {}

    def __getstate__(self):
        return self.hosts, self.known, self.layers

    def __setstate__(self, state):
        self.__init__(*state)
        self.known = Lines(self.known)

    def of(self, host: str | None, layer: str | None, lines: list[str] | None = None) -> tuple[Lines, Lines, dict[str, list[float]]]:
        """(repeated, known, layer) as furniture_lines takes them."""
        key = host or ""
        if key not in self.read:
            if len(self.read) > 2_000:
                self.read.clear()
            self.read[key] = Lines((lines or ()) if self.hosts is None else self.hosts.get(key, ()))
        return self.read[key], self.known, self.layers.get(layer or "", {})


def _host_lines(rows: DataFrame) -> tuple[DataFrame, list[str], dict[str, dict[str, list[float]]]]:
    """((host, lines) of all hosts, the lines known on all hosts, and the sums of paths by layer).

    rows: (host, layer, content). lines: keys of lines, code aside, that a host repeats over pages of distinct texts. What
    is found depends on shares, not on the number of pages. At most lines a page / KNOWN_SHARE lines are known,
    and paths on less than a ten-thousandth of a layer's leaves are left to the page's own sums, so both are bounded.
    """
    sums = [F.sum("n").alias("n"), F.bit_or("a").alias("a"), F.bit_or("b").alias("b"), *(F.sum(c).alias(c) for c in ("outside", "chars", "ends", "linked"))]
    counted = _counted(rows).groupBy("host", "layer", "line").agg(*sums)
    # read four times below; a line inside one page only is neither repeated nor known
    both = written(counted.where("host IS NULL OR n > 1 OR outside > 0 OR line = ''"), "furniture-counts")
    counts = both.where("host IS NOT NULL")
    of_path = both.where("host IS NULL")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("layer"))
    layers: dict[str, dict[str, list[float]]] = defaultdict(dict)
    for r in of_path.withColumn("share", share).where("share >= 1e-4").collect():
        layers[r.layer][r.line] = [r.chars, r.ends, r.linked, float(r.n)]
    pages = counts.where("line = ''").agg(F.sum("n")).first()[0] or 0
    known = counts.where("outside > 0 AND line <> ''").groupBy("line").agg(F.count("*").alias("hosts"), F.sum("n").alias("pages"), F.sum("outside").alias("outside"))
    least = F.when(F.col("line").rlike(_ENDED.pattern), KNOWN_SENTENCE).otherwise(KNOWN_OUTSIDE)
    known = known.where((F.col("hosts") >= KNOWN_HOSTS) & (F.col("pages") >= KNOWN_SHARE * pages) & (F.col("outside") >= least * F.col("pages")) & ~F.startswith("line", F.lit(_ITEM)))
    often = counts.where(f"n >= {SURE_PAGES} OR line = ''").select("host", "line", _distinct("n", "a", "b").alias("n"))
    total = often.where("line = ''").select("host", F.col("n").alias("pages"))
    share, z2 = F.least(F.col("n") / F.col("pages"), F.lit(1.0)), 4 / F.col("pages")
    sure = (share + z2 / 2 - F.sqrt(z2 * (share * (1 - share) + z2 / 4))) / (1 + z2)
    least = F.when(F.startswith("line", F.lit(_ITEM)), REPEATED_SHARE).otherwise(SURE_SHARE)
    many = (F.col("n") >= REPEATED_PAGES) & (share >= REPEATED_SHARE) & ~F.startswith("line", F.lit(_ITEM))
    own = often.where(f"line NOT IN ('', '{_ITEM}') AND host <> '' AND n >= {SURE_PAGES}").join(total, "host").where(many | (sure >= least))
    return own.groupBy("host").agg(F.collect_list("line").alias("lines")), [r[0] for r in known.select("line").collect()], layers


def with_templates(rows: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(rows with `lines`, Templates for all tasks); rows: (host, layer, content, ...), lines null but where they come with the rows.

    The templates of all hosts go to the tasks while their size, which is checked, is small; beyond it they are joined
    by host, where Spark splits a host that is skewed.
    """
    found, known, layers = _host_lines(rows)
    found = written(found, "furniture-templates")
    small = small_enough(found.select(F.length(F.concat_ws("", "lines")).alias("n")), "n")
    hosts = {r.host: r.lines for r in found.collect()} if small else None
    held = rows.sparkSession.sparkContext.broadcast(Templates(hosts, known, layers))
    if small:
        return rows.withColumn("lines", F.lit(None).cast("array<string>")), held
    return rows.join(found.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").drop("h"), held


def _judged(pages: DataFrame, id_col: str, title_col: str, content_col: str, url_col: str, layer_col: str, run, schema) -> DataFrame:
    layer = F.col(layer_col) if layer_col in pages.columns else F.lit(None).cast("string")
    rows = spread(pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), F.col(title_col).alias("title"), F.col(content_col).alias("content"), layer.alias("layer")))
    joined, held = with_templates(rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for host, title, content, layer, lines in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
                gone.append(furniture_lines(content, title, host, *held.value.of(host, layer, lines)) if content else [])
            yield run(batch, gone)

    return joined.select("id", "host", "title", "content", "layer", "lines").mapInArrow(judge, schema)


def find_furniture(pages: DataFrame, id_col: str = "content_id", title_col: str = "title", content_col: str = "content", url_col: str = "url", layer_col: str = "layer_used") -> DataFrame:
    """(id_col, line_no): a row for each non-blank line that is page furniture, lines numbered from 1 at each newline.

    Null or empty content has no lines. Without a url or title the page is judged by itself, without a layer by its own
    paths. Repeated rows give their lines again; other columns play no part, whatever their names. The counts
    of all pages are made while this is called.
    """

    def run(batch: pa.RecordBatch, gone: list[list[int]]) -> pa.RecordBatch:
        at = [i for i, nos in enumerate(gone) for _ in nos]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([n for nos in gone for n in nos], pa.int64())], names=[id_col, "line_no"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("line_no", T.LongType())])
    return _judged(pages, id_col, title_col, content_col, url_col, layer_col, run, schema)


def main_body(pages: DataFrame, id_col: str = "content_id", title_col: str = "title", content_col: str = "content", url_col: str = "url", layer_col: str = "layer_used") -> DataFrame:
    """(id_col, body, kept_lines, cut_lines): each page without its furniture lines, in order; null stays null."""

    def run(batch: pa.RecordBatch, gone: list[list[int]]) -> pa.RecordBatch:
        bodies, kept = [], []
        for content, nos in zip(batch.column(3).to_pylist(), gone):
            lines, cut = content.split("\n") if content is not None else [], set(nos)
            bodies.append("\n".join(x for n, x in enumerate(lines, 1) if n not in cut) if content is not None else None)
            kept.append(len(lines) - len(cut))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(kept, pa.int64()), pa.array(list(map(len, gone)), pa.int64())], names=[id_col, "body", "kept_lines", "cut_lines"])

    fields = [T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("body", T.StringType()), T.StructField("kept_lines", T.LongType()), T.StructField("cut_lines", T.LongType())]
    return _judged(pages, id_col, title_col, content_col, url_col, layer_col, run, T.StructType(fields))
