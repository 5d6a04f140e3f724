"""Text decoded with the wrong character encoding: detection and restoration by minimum description length.

The unit is the line, as pages are often damaged in part. Every chain of up to three wrong decodings that could
have made the line is undone; what comes out is compressed with zstandard dictionaries of each language,
and the reading of least description length, the cost of its chain included, wins. The line stays as it is where
no chain pays. Dictionaries and alphabet are counted over the clean lines of all texts.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.subjects import language
from gleanwork.session import spread, written

#: Nothing is sampled, whatever this is set to: models are counted over all texts.
SAMPLE_PAGES = None
#: Bytes of a language's dictionary, of the parts it is made of, and of the lines put together from these.
DICTIONARY_BYTES, PART_BYTES, MADE_BYTES = 16_384, 131_072, 500_000
#: Compression level: at high ones a length is the least that matches can give, so two readings compare by what they hold.
LEVEL = 19
#: Characters and keys that a task counts before it hands on its sums.
MOST_READ, MOST_KEYS = 16_000_000, 200_000
#: A character belongs to the alphabet if it stands in so many clean lines, and in this share of those that aren't ASCII.
LEAST_LINES, LEAST_SHARE = 3, 7e-5
#: Bytes that each step of a chain must save.
CHAIN_COST = 0.5
#: Bytes for a character outside the alphabet or a capital within a word, and those a change between legacy encodings must save besides.
NOVEL, LEGACY_COST = 4.0, 5.0

#: (read as, written as): what a line's characters are turned back into, and how its bytes were meant.
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8_r", "iso8859_15", "iso8859_5")
LATIN_READ, CYRILLIC_READ = ("cp1252", "iso8859_15"), ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
LEGACY = ("gbk", "euc_jp", "shift_jis", "big5", "cp1251", "koi8_r", "cp866")
CJK_READ = ("gbk", "euc_jp", "shift_jis", "big5")
#: Languages without spaces between words.
UNSPACED = ("ja", "zh")

_REPLACED = "�"
_MENTIONED = re.compile(r"[\"'“”‘’«»„`(]\s?" + _REPLACED + r"{1,3}\s?[\"'“”‘’«»)`]")
_AT_END = re.compile(_REPLACED + r"{1,3}(?:\s*(?:…|\.\.\.|\[…\]|\[\.\.\.\]))?\s*$")
_HIGH = re.compile("[\x80-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯！-ﾟ]")
_INNER_CAPITAL = re.compile("[а-яё][А-ЯЁ]|[А-ЯЁ]{4}")
#: Whether there is one; it begins with the rarer set, which is faster to search for.
_ANY_INNER_CAPITAL = re.compile("[А-ЯЁ](?:(?<=[а-яё][А-ЯЁ])|[А-ЯЁ]{3})")
_ODD = re.compile("[\x80-\x9f-" + _REPLACED + "]")
#: What a quotation of a damaged sequence turns into: one letter, apostrophe or quote by itself.
_ALONE = re.compile(r"[^\W\d_]|['’‘“”\"„]")


def to_bytes(text: str, codec: str) -> bytes | None:
    """text in codec; code points that browsers read as control characters in cp1252 count as these bytes."""
    try:
        return text.encode(codec)
    except UnicodeError:
        if codec != "cp1252":
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeError:
            if 0x80 <= ord(c) < 0xA0:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def _lead_sets(codec: str) -> tuple[str, str]:
    """What the first byte of a multi-byte UTF-8 character, and the second, look like when read as codec, as insides of sets."""
    image = lambda lo, hi: "".join(re.escape(c) for i in range(lo, hi) for c in {bytes([i]).decode(codec, "ignore") or (chr(i) if codec == "cp1252" else "")} if c)
    return image(0xC2, 0xF5), image(0x80, 0xC0) + (chr(0x80) + "-" + chr(0x9F) if codec == "cp1252" else "")


_LEAD_SETS = {codec: _lead_sets(codec) for codec in SINGLE_BYTE}
_LEADS = {codec: re.compile(f"[{a}][{b}]") for codec, (a, b) in _LEAD_SETS.items()}
#: Whether one of _LEADS is there: places are found by one set for all codecs, which is faster to search for than alternatives.
_ANY_LEAD = re.compile(
    f"[{''.join(a for a, _ in _LEAD_SETS.values())}](?=[{''.join(b for _, b in _LEAD_SETS.values())}])(?:{'|'.join(f'(?<=[{a}])[{b}]' for a, b in _LEAD_SETS.values())})"
)


def dense(line: str) -> bool:
    """Whether more than a third of a line are upper Latin-1 characters, as of no clean text."""
    return 3 * len(_HIGH.findall(line)) > len(line) - line.count(" ")


def undone(line: str, strange: bool = True) -> Iterator[tuple[str, str]]:
    """(chain, text) for each single wrong decoding that could have made line.

    strange: whether the line has characters that clean text doesn't use, or capitals within words; only
    then can it be text of one legacy encoding read as another.
    """
    singles = [c for c, leads in _LEADS.items() if leads.search(line)] if _ANY_LEAD.search(line) else []
    for read in (*singles, *(CJK_READ if strange and _CJK.search(line) else ())):
        raw = to_bytes(line, read)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeError:
            continue
        if text != line:
            yield f"utf-8>{read}", text
    if not strange:
        return
    reads = []
    if dense(line):
        reads += [(r, LEGACY) for r in LATIN_READ]
    if _CYRILLIC.search(line):
        reads += [(r, ("cp1251", "koi8_r", "cp866", "gbk")) for r in CYRILLIC_READ]
    if _CJK.search(line):
        reads += [(r, CJK_READ) for r in CJK_READ]
    for read, metas in reads:
        raw = to_bytes(line, read)
        if raw is None:
            continue
        for meant in metas:
            if meant != read:
                try:
                    text = raw.decode(meant)
                except UnicodeError:
                    continue
                if text != line and not _ODD.search(text):
                    yield f"{meant}>{read}", text


def shifted(line: str) -> bool:
    """Whether a line may be text of one legacy single-byte encoding read as another."""
    return dense(line) or _CYRILLIC.search(line) is not None and _ANY_INNER_CAPITAL.search(line) is not None


class Judge:
    """Description lengths by per-language dictionaries, and the best reading of a line.

    A description is the compressed line, plus NOVEL bytes for each character that the clean lines don't
    use, as no dictionary can hold it, and for each capital within a word.
    """

    def __init__(self, dictionaries: dict[str, bytes], alphabet: str):
        self.compressors = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        if not self.compressors:
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        self.alphabet = frozenset(alphabet)
        self.known: dict[str, tuple[str, str]] = {}

    def strange(self, line: str) -> bool:
        return not self.alphabet.issuperset(line) or _CYRILLIC.search(line) is not None and _ANY_INNER_CAPITAL.search(line) is not None

    def length(self, text: str) -> float:
        raw = text.encode("utf-8", "surrogatepass")
        novel = sum(1 for c in text if c not in self.alphabet and c > "\x7f")
        return min(len(c.compress(raw)) for c in self.compressors) + NOVEL * (novel + len(_INNER_CAPITAL.findall(text)))

    def best(self, line: str) -> tuple[str, str]:
        """(chain, text) of the best reading; an empty chain leaves the line as it is."""
        if line.isascii():
            return "", line
        if len(line) < 200 and line in self.known:
            return self.known[line]
        first = list(undone(line, self.strange(line)))
        best = ("", line)
        if first:
            least, tried, steps = self.length(line), {line}, 1
            while first and steps <= 3:
                following = []
                for chain, text in first:
                    if text in tried:
                        continue
                    tried.add(text)
                    high = [c for c in text if c > "\x7f"]
                    if not chain.startswith("utf-8") and 3 * sum(c not in self.alphabet for c in high) > len(high):
                        continue  # bytes were lost, or it is none of these encodings
                    cost = self.length(text) + CHAIN_COST * steps + (LEGACY_COST if not chain.startswith("utf-8") else 0)
                    if cost < least:
                        least, best = cost, (chain, text)
                    if not text.isascii() and chain.startswith("utf-8"):
                        following += [(f"{c}>{chain}", t) for c, t in undone(text, False)]
                first, steps = following, steps + 1
        if len(line) < 200:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[line] = best
        return best

    def lossy(self, line: str) -> bool:
        """Whether a line can't be clean though nothing restores it: bytes were lost on the way.

        Beside replacement characters most others are strange, or most of its letters are accented Latin ones.
        """
        rest = [c for c in line.replace(_REPLACED, "") if c > "\x7f"]
        if _REPLACED in line and 3 * sum(c not in self.alphabet for c in rest) > len(rest) > 1:
            return True
        high = len(_HIGH.findall(line))
        return high >= 5 and 2 * high > len(line) - line.count(" ")


def _pieces(line: str, text: str) -> list[str]:
    """The parts of the restored text that the line did not have, apart from what both share at the ends."""
    a, b = line.split(" "), text.split(" ")
    return [y for x, y in zip(a, b) if x != y] if len(a) == len(b) else [text]


def examine(value: str | None, judge: Judge) -> tuple[bool, str | None, str]:
    """(damaged, restored, chains) of a value; restored is null where nothing could be restored.

    A line whose only damage is one sequence that stands by itself as a lone letter or quote is a quotation
    unless other lines of the value are damaged. A replacement character counts unless it is quoted or the
    damaged last character of a cut line.
    """
    if not value or value.isascii():
        return False, None, ""
    lines = value.split("\n")
    out, chains, quoted, damaged, lost = list(lines), [], [], False, False
    for i, line in enumerate(lines):
        if line.isascii():
            continue
        chain, text = judge.best(line)
        if not chain:
            lost = lost or judge.lossy(line)
            continue
        pieces = _pieces(line, text)
        if len(pieces) == 1 and _ALONE.fullmatch(pieces[0].strip("\"'“”‘’«»„()`.,") or pieces[0]):
            quoted.append((i, chain, text))
            continue
        out[i], damaged = text, True
        chains.append(chain)
    if damaged:
        for i, chain, text in quoted:
            if chain in chains:
                out[i] = text
    restored = "\n".join(out) if damaged else None
    if not damaged and _REPLACED in value:
        held = [line for line in lines if _REPLACED in line]
        marked = [_MENTIONED.sub("", line) for line in held]
        ended = [line for line in marked if _REPLACED in _AT_END.sub("", line)]
        at_end = sum(_REPLACED in line for line in marked)
        damaged = bool(ended) or at_end > 1
    return damaged or lost, restored, ", ".join(dict.fromkeys(chains))


def _clean(line: str) -> bool:
    return line.isascii() or not _ODD.search(line) and not dense(line) and next(undone(line, bool(_CJK.search(line)) and not _CYRILLIC.search(line)), ("legacy",))[0][:5] != "utf-8"


def _parts(line: str, lang: str) -> Iterator[tuple[str, ...]]:
    """What a dictionary is made of: pairs of words of a line, of unspaced scripts pairs of characters."""
    words = line if lang in UNSPACED else line.split(" ")
    return zip(words, words[1:]) if len(words) > 1 else iter([(line,)])


def _count_lines(lines: dict[str, int], uses: dict[str, Counter]) -> None:
    """Adds the clean lines, each as often as lines says: by language its parts, and under "" the alphabet.

    The alphabet has one for each character of a line that isn't ASCII, and one for the line under "".
    Lines that may be garbled in part only, or by legacy encodings, don't count: of all lines, they would be many.
    """
    for line, n in lines.items():
        if not line.isascii():
            if _LEADS["cp1252"].search(line) or shifted(line) or not _clean(line):
                continue
            held = uses[""]
            for c in set(line):
                held[c] += n
            held[""] += n
        lang = language(line)
        held = uses[lang]
        if n == 1:
            held.update(_parts(line, lang))
        else:
            for part in _parts(line, lang):
                held[part] += n


def _in_use(uses: dict[str, int]) -> str:
    least = max(LEAST_LINES, LEAST_SHARE * uses.get("", 0))
    return "".join(sorted({c for c, n in uses.items() if c and n >= least} | {chr(i) for i in range(128)}))


def _counted(texts: DataFrame) -> DataFrame:
    """(lang, part, n): how often a part of a language stands in the clean lines of all columns; the alphabet under lang ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[str, Counter] = defaultdict(Counter)
        read = 0

        def emit():
            nonlocal read
            langs = [lang for lang, held in uses.items() for _ in held]
            parts = [("" if lang in UNSPACED else " ").join(part) for lang, held in uses.items() for part in held]
            ns = [n for held in uses.values() for n in held.values()]
            uses.clear()
            read = 0
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.string()), pa.array(ns, pa.int64())], names=["lang", "part", "n"])

        for batch in batches:
            lines: Counter = Counter()
            for column in batch.columns:
                for text in column.to_pylist():
                    if text:
                        lines.update(text.split("\n"))
                        read += len(text)
            del lines[""]
            _count_lines(lines, uses)
            if read > MOST_READ or sum(map(len, uses.values())) > MOST_KEYS:
                yield emit()
        yield emit()

    return spread(texts).mapInArrow(run, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))


def _trained(parts: list[tuple[str, int]], between: str) -> bytes:
    """A zstandard dictionary of lines made of parts, each as often as its share of uses says, alike at each run.

    Of lines, as zstandard takes no counts, and needs them for the entropy tables besides the content.
    """
    total = sum(n * len((part + between).encode("utf-8")) for part, n in parts)
    bag = [part for part, n in parts for _ in range(max(1, round(n * MADE_BYTES / total)))]
    random.Random(0).shuffle(bag)
    lines = [between.join(bag[i : i + 12]).encode("utf-8") for i in range(0, len(bag), 12)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, lines, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few parts: they serve as the dictionary, the best last, where offsets are short
        return between.join(part for part, _ in reversed(parts)).encode("utf-8")[-DICTIONARY_BYTES:]


def dictionaries(texts: DataFrame) -> tuple[dict[str, bytes], str]:
    """A zstandard dictionary for each language and the alphabet of all, counted over every clean line of texts (string columns).

    A dictionary is made of the parts that fill most bytes in all lines. PART_BYTES of them are kept for a language, so
    what reaches the driver is bounded, by Unicode for the alphabet.
    """
    counts = written(_counted(texts).where("lang = '' OR n > 1"), "mojibake-counts")  # one use saves nothing
    size = F.octet_length("part") + F.when(F.col("lang").isin(*UNSPACED), 0).otherwise(1)
    valued = counts.where("lang <> ''").withColumns({"size": size, "filled": F.col("n") * size}).where(size.between(2, DICTIONARY_BYTES))
    for by in (("lang", F.pmod(F.xxhash64("part"), F.lit(64))), ("lang",)):  # no language is sorted whole
        best = Window.partitionBy(*by).orderBy(F.desc("filled"), "part")
        valued = valued.withColumn("upto", F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= PART_BYTES)
    parts: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in sorted(valued.select("lang", "upto", "part", "n").collect()):
        parts[r.lang].append((r.part, r.n))
    out = {lang: _trained(kept, "" if lang in UNSPACED else " ") for lang, kept in sorted(parts.items())}
    return out, _in_use({r.part: r.n for r in counts.where("lang = ''").collect()})


def find_damaged(df: DataFrame, columns: list[str], id_col: str = "content_id", sample_col: str | None = None) -> DataFrame:
    """(field, id_col, restored, chain): a row for each value of columns of which a part was decoded wrongly.

    restored has the value with every restorable line put right, null where none is; chain lists the decodings that
    were undone, from the meant one to the last wrong one. The dictionaries are of sample_col if it is given, else of columns. Null and empty values give no row; repeated rows give
    theirs again; other columns play no part, whatever their names.
    """
    texts = spread(df.select(id_col, *columns))
    held = df.sparkSession.sparkContext.broadcast(dictionaries(df.select(*([sample_col] if sample_col else columns))))  # 16 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*held.value)
        for batch in batches:
            at, fields, restored, chain = [], [], [], []
            for c, name in enumerate(columns, 1):
                for i, value in enumerate(batch.column(c).to_pylist()):
                    damaged, text, how = examine(value, judge)
                    if damaged:
                        at.append(i)
                        fields.append(name)
                        restored.append(text)
                        chain.append(how)
            yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(restored, pa.string()), pa.array(chain, pa.string())], names=["field", id_col, "restored", "chain"])

    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField(id_col, df.schema[id_col].dataType), T.StructField("restored", T.StringType()), T.StructField("chain", T.StringType())])
    return texts.mapInArrow(run, schema)
