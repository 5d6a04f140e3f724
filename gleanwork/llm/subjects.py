"""Subjects of documents: classifier chains over term, source and structure features, decoded by beam search.

Term evidence is counted over the whole corpus in rounds. The first round counts (language, term) by
subject over labelled documents; each further one adds every document whose subjects the round before
found with confidence, at half weight. A sentence's evidence is the sum of its terms' log ratios
log P(subject | term) / P(subject | language), so words that only mark a language carry none. Texts are read once,
into a table of hashed terms by sentence, on which all rounds run in numpy over whole batches. The share of
text that each subject fills, with source and structure features, goes into a chain of calibrated logistic
models, one for each subject given the labels before it; beam search picks the likeliest combination.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.bounded import sampled
from gleanwork.session import spread, written

# Frequent words that tell the Latin-script languages of the corpus apart.
COMMON_WORDS = {
    "en": "the a of and is to for that in on",
    "de": "der die das und ist nicht für den von mit wer man",
    "fr": "le la les et est dans une des du au après sans pour que à",
    "es": "el la los y es en una del después según más que por",
}
_COMMON = {lang: frozenset(words.split()) for lang, words in COMMON_WORDS.items()}
_ANY_COMMON = frozenset().union(*_COMMON.values())
_KANA, _HAN, _CYRILLIC = re.compile("[぀-ヿ]"), re.compile("[㐀-鿿]"), re.compile("[Ѐ-ӿ]")
_RUN = re.compile("[぀-ヿ㐀-鿿]+|[^\\W\\d_぀-ヿ㐀-鿿]+(?:-[^\\W\\d_぀-ヿ㐀-鿿]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")

#: Documented bound of the classifier's sample: labelled documents that the chain and the sources' ratios are fitted on.
MOST_LABELLED = 20_000
#: A term counts if this share of its language's sentences that have subjects hold it, and LEAST_SEEN at least; so the
#: number of terms is bounded by terms a sentence / TERM_SHARE for each language, at any size of the corpus.
TERM_SHARE, LEAST_SEEN = 2e-5, 1.5
#: Terms looked up at once in a task.
CHUNK = 400_000
PRIOR_WEIGHT, MARGIN, FAINT_MARGIN, SURE, PSEUDO_WEIGHT, CLEAR_SHARE = 2.0, 1.0, 0.4, 0.8, 0.5, 0.3
BEAM = 8


def language(text: str) -> str:
    """ja, zh, ru or the Latin-script language whose frequent words occur most; en if none does."""
    if text.isascii():
        words = text.lower().split(" ")
    else:
        if _KANA.search(text):
            return "ja"
        if _HAN.search(text):
            return "zh"
        words = re.findall(r"[^\W\d_]+", text.lower())
        if _CYRILLIC.search(text) and sum(1 for w in words if _CYRILLIC.match(w)) * 2 > len(words):
            return "ru"
    told = [w for w in words if w in _ANY_COMMON]
    return max(_COMMON, key=lambda lang: (sum(w in _COMMON[lang] for w in told), lang == "en")) if told else "en"


LANGUAGES = ("en", "de", "fr", "es", "ru", "zh", "ja")


def parse(text: str) -> tuple[str, list[tuple[int, set[str]]]]:
    """The language by its words and the sentences of a text."""
    parts = sentences(text)
    if _KANA.search(text):
        return "ja", parts
    if _HAN.search(text):
        return "zh", parts
    if _CYRILLIC.search(text) and sum(1 for _, terms in parts for t in terms if _CYRILLIC.match(t)) * 2 > sum(len(terms) for _, terms in parts):
        return "ru", parts
    return max(_COMMON, key=lambda lang: (sum(len(_COMMON[lang] & terms) for _, terms in parts), lang == "en")), parts


def sentences(text: str) -> list[tuple[int, set[str]]]:
    """Length and distinct terms of each sentence: words, and pairs of characters where words aren't spaced."""
    out = []
    for s in _SENTENCE.split(text):
        terms = set()
        for run in _RUN.findall(s.lower()):
            if "぀" <= run[0] <= "鿿":
                terms.update(run[i : i + 2] for i in range(len(run) - 1))
            elif len(run) > 1:
                terms.add(run)
        if terms:
            out.append((len(s), terms))
    return out


PARSED = "doc_id {}, source string, lang int, sizes array<int>, counts array<int>, terms array<long>"


def read_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, sizes, counts, terms): of each text with a sentence its language, the sentences' lengths and numbers of terms, and all terms in order.

    A term is the 64-bit hash of its word in its language. documents: (doc_id, text, source).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            at, langs, sizes, counts, terms = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                lang, parts = parse(text) if text else ("en", [])
                if not parts:
                    continue
                if len(held) > 1_000_000:
                    held.clear()
                n, shift = [], LANGUAGES.index(lang) * 0x1E3779B97F4A7C15
                flat = []
                for _, words in parts:
                    n.append(len(words))
                    for w in words:
                        h = held.get(w)
                        if h is None:
                            h = held[w] = xxhash.xxh3_64_intdigest(w)
                        flat.append(h)
                at.append(i)
                langs.append(LANGUAGES.index(lang))
                sizes.append([size for size, _ in parts])
                counts.append(n)
                terms.append((np.array(flat, np.uint64) ^ np.uint64(shift & (2**64 - 1))).view(np.int64))
            took = pa.array(at, pa.int64())
            flat = pa.array(np.concatenate(terms) if terms else np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32))
            columns = [batch.column(0).take(took), batch.column(2).take(took), pa.array(langs, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "lang", "sizes", "counts", "terms"])

    return documents.mapInArrow(run, PARSED.format(documents.schema["doc_id"].dataType.simpleString()))


@dataclass
class Read:
    """A slice of parsed documents as flat arrays."""

    lang: np.ndarray  # by document
    parts: np.ndarray  # sentences by document
    sizes: np.ndarray  # by sentence
    counts: np.ndarray  # terms by sentence
    terms: np.ndarray

    @classmethod
    def slices(cls, batch: pa.RecordBatch) -> Iterator[tuple[int, "Read"]]:
        """(place of the first document, documents) in pieces of about CHUNK terms."""
        column = {name: batch.column(batch.schema.get_field_index(name)) for name in ("lang", "sizes", "counts", "terms")}
        ends = np.cumsum(column["terms"].value_lengths().to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, base + CHUNK, "right")), first + 1)
            part = {name: c.slice(first, last - first) for name, c in column.items()}
            flat = lambda name: part[name].flatten().to_numpy(zero_copy_only=False)
            yield first, cls(part["lang"].to_numpy(zero_copy_only=False), part["sizes"].value_lengths().to_numpy(zero_copy_only=False), flat("sizes"), flat("counts"), flat("terms"))
            first = last

    def documents(self) -> np.ndarray:
        """The place of the document of each sentence."""
        return np.repeat(np.arange(len(self.parts)), self.parts)


@dataclass
class Terms:
    """Counts of sentences by term and subject, and each language's subject distribution; keys ascend."""

    subjects: list[str]
    keys: np.ndarray
    langs: np.ndarray
    counts: np.ndarray
    prior: np.ndarray  # by language

    def __post_init__(self):
        self.logs = self.ratios(self.counts, self.prior[self.langs]).astype(np.float32)

    @staticmethod
    def ratios(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log((counts + PRIOR_WEIGHT * prior) / (counts.sum(1, keepdims=True) + PRIOR_WEIGHT) / prior)

    def shares(self, read: Read, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Share of the informative text by subject, and its length, for each document; own: labels of each, whose counts are left out."""
        n, k = len(read.parts), len(self.subjects)
        share, total = np.zeros((n, k)), np.zeros(n)
        if not len(self.keys) or not len(read.terms):
            return share, total
        row = np.minimum(np.searchsorted(self.keys, read.terms), len(self.keys) - 1)
        known = self.keys[row] == read.terms
        row, sentence = row[known], np.repeat(np.arange(len(read.counts)), read.counts)[known]
        if not len(row):
            return share, total
        logs = self.logs[row] if own is None else self._without(row, read.documents()[sentence], own)
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        v, of = np.add.reduceat(logs, starts, axis=0), sentence[starts]
        top = np.partition(v, k - 2, axis=1) if k > 1 else np.hstack([np.zeros_like(v), v])
        size, margin, doc = read.sizes[of], top[:, -1] - top[:, -2], read.documents()[of]
        weight = size * (margin >= MARGIN)
        clear = np.bincount(doc, weight, n) > 0
        several = np.bincount(read.documents()[sentence], minlength=n) > 1
        faint = (~clear & several)[doc]  # a short text may hold no clearer sentence
        weight = np.where(faint, size * (margin >= FAINT_MARGIN), weight)
        p = np.exp(v - v.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * weight[:, None]
        total = np.bincount(doc, weight, n)
        share = np.stack([np.bincount(doc, p[:, j], n) for j in range(k)], axis=1)
        return share / np.maximum(total, 1e-9)[:, None], total

    def _without(self, row: np.ndarray, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log ratios of terms, without what their own documents gave to the counts."""
        pair, inverse, times = np.unique(np.stack([doc, row], axis=1), axis=0, return_inverse=True, return_counts=True)
        left = np.maximum(self.counts[pair[:, 1]] - times[:, None] * own[pair[:, 0]], 0)
        return self.ratios(left, self.prior[self.langs[pair[:, 1]]])[inverse.ravel()]


def _label_row(labels, subjects: list[str]) -> np.ndarray | None:
    row = np.array([float(s in labels) for s in subjects]) if labels else np.zeros(len(subjects))
    return row / row.sum() if row.any() else None


def _label_rows(batch: pa.RecordBatch, subjects: list[str]) -> np.ndarray:
    """A row of weights for each document, zeros for those without labels."""
    out = np.zeros((batch.num_rows, len(subjects)))
    for i, labels in enumerate(batch.column(batch.schema.get_field_index("labels")).to_pylist()):
        if (row := _label_row(labels, subjects)) is not None:
            out[i] = row
    return out


def _count(docs: DataFrame, subjects: list[str], model) -> Terms:
    """One round: a sum over terms of the sentences' subject weights; partial sums leave each task."""
    k = len(subjects)
    columns = [f"w{i}" for i in range(k)]

    def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        terms, langs, sums = (np.concatenate(x) for x in zip(*parts))
        keys, first, inverse = np.unique(terms, return_index=True, return_inverse=True)
        return keys, langs[first], np.stack([np.bincount(inverse, sums[:, j], len(keys)) for j in range(k)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value if model is not None else None
        held: list[tuple] = []

        def emit():
            keys, langs, sums = merged(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, k)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.int32()), pa.array(keys), *(pa.array(sums[:, j]) for j in range(k))], names=["lang", "term", *columns])

        for batch in batches:
            rows = _label_rows(batch, subjects)
            for first, read in Read.slices(batch):
                weights = rows[first : first + len(read.parts)]
                if known is not None:
                    share, _ = known.shares(read)
                    clear = share >= CLEAR_SHARE
                    sure = (weights.sum(1) == 0) & ((share * clear).sum(1) >= SURE)
                    weights = np.where(sure[:, None], PSEUDO_WEIGHT * clear / np.maximum(clear.sum(1, keepdims=True), 1), weights)
                doc = np.repeat(read.documents(), read.counts)
                used = weights.any(1)
                if not used.any():
                    continue
                took = used[doc]
                langs = np.flatnonzero(used)  # the language itself has the place of term 0
                held.append(merged([(read.terms[took], read.lang[doc[took]], weights[doc[took]])]))
                held.append((-1 - read.lang[langs].astype(np.int64), read.lang[langs], weights[langs] * read.parts[langs][:, None]))
            if sum(len(h[0]) for h in held) > 400_000:
                held[:] = [merged(held)]
                if len(held[0][0]) > 200_000:
                    yield emit()
        yield emit()

    parts = docs.select("lang", "sizes", "counts", "terms", "labels").mapInArrow(run, "lang int, term long, " + ", ".join(f"{c} double" for c in columns))
    total = parts.groupBy("lang", "term").agg(*(F.sum(c).alias(c) for c in columns)).withColumn("n", sum(F.col(c) for c in columns))
    total = written(total, "subjects-terms")  # read twice below
    of_lang = F.col("term") == -1 - F.col("lang")
    spoken = {r.lang: (np.array([r[c] for c in columns]), r.n) for r in total.where(of_lang).collect()}  # a row for each language
    everywhere = sum((n for n, _ in spoken.values()), np.full(k, 1e-3))
    prior = np.tile(everywhere / everywhere.sum(), (len(LANGUAGES), 1))
    for lang, (n, _) in spoken.items():
        prior[lang] = (n + 20 * everywhere / everywhere.sum()) / (n.sum() + 20)
    least = F.lit(LEAST_SEEN)
    for lang, (_, n) in spoken.items():
        least = F.when(F.col("lang") == lang, max(LEAST_SEEN, TERM_SHARE * n)).otherwise(least)
    rows = total.where(~of_lang & (F.col("n") >= least)).orderBy("term").toArrow()  # bounded by TERM_SHARE
    column = lambda c: rows.column(c).to_numpy()
    return Terms(subjects, column("term"), column("lang"), np.stack([column(c) for c in columns], axis=1).reshape(-1, k), prior)


def _features(share: np.ndarray, total: np.ndarray, read: Read, source_rows: np.ndarray) -> np.ndarray:
    """Per subject: log odds of its share, log ratio of its source; per document: structure and the largest shares."""
    odds = np.log((share + 0.02) / (1.02 - share))
    top = -np.sort(-share, axis=1)[:, :2]
    if top.shape[1] < 2:
        top = np.hstack([top, np.zeros((len(top), 1))])
    mean = np.bincount(read.documents(), read.sizes, len(read.parts)) / np.maximum(read.parts, 1) / 100
    shape = [np.log1p(total), np.log1p(read.parts), mean, top[:, 0], top[:, 1], read.lang != 0]
    return np.hstack([odds, source_rows, np.stack([np.asarray(x, float) for x in shape], axis=1)])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with a ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """order: subjects, most frequent first. weights[i]: of the bias, the chosen features and the i labels before."""

    order: list[int]
    weights: list[np.ndarray]
    k: int

    @staticmethod
    def view(features: np.ndarray, s: int, k: int, before: np.ndarray) -> np.ndarray:
        f = np.concatenate([features[:, [s, k + s]], features[:, 2 * k :]], axis=1)
        rest = np.delete(features[:, :k], s, axis=1)
        rival = rest.max(1, keepdims=True) if k > 1 else np.zeros((len(f), 1))
        return np.hstack([np.ones((len(f), 1)), f, rival, before])

    @classmethod
    def fitted(cls, features: np.ndarray, labels: np.ndarray) -> "Chain":
        k = labels.shape[1]
        order = np.argsort(-labels.sum(0), kind="stable").tolist()
        weights = []
        fold = np.arange(len(labels)) % 3
        for i, s in enumerate(order):
            x, y = cls.view(features, s, k, labels[:, order[:i]]), labels[:, s]
            if y.min() == y.max():
                w = np.zeros(x.shape[1])
                w[0] = 8.0 if len(y) and y[0] else -8.0
            else:
                z = np.zeros(len(y))  # held-out scores, on which slope and shift are calibrated
                for f in range(3):
                    z[fold == f] = x[fold == f] @ _fit(x[fold != f], y[fold != f])
                slope = _fit(np.stack([np.ones(len(z)), z], axis=1), y, 0.1)
                w = _fit(x, y) * slope[1]
                w[0] += slope[0]
            weights.append(w)
        return cls(order, weights, k)

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest label combination with at least one subject, for each row."""
        n, k = len(features), self.k
        beams, score = np.zeros((n, 1, k)), np.zeros((n, 1))
        for i, s in enumerate(self.order):
            b = beams.shape[1]
            before = beams[:, :, self.order[:i]].reshape(n * b, i)
            x = self.view(np.repeat(features, b, axis=0), s, k, before)
            z = (x @ self.weights[i]).reshape(n, b)
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            with_s = beams.copy()
            with_s[:, :, s] = 1
            beams, score = np.concatenate([beams, with_s], axis=1), np.concatenate([score + no, score + yes], axis=1)
            if i == k - 1:
                score = np.where(beams.any(2), score, -np.inf)
            keep = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
            beams, score = np.take_along_axis(beams, keep[:, :, None], 1), np.take_along_axis(score, keep, 1)
        return beams[:, 0].astype(bool)


def _source_rows(labelled: DataFrame, subjects: list[str]) -> dict[str, np.ndarray]:
    """Log ratio of each subject for the sources of labelled documents, a bounded sample; others have zeros."""
    n = labelled.select("source", F.explode("labels").alias("s")).where("source IS NOT NULL").groupBy("source", "s").count()
    rows = n.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("s", "count"))).alias("m")).collect()
    total = np.full(len(subjects), 0.5)
    held = {}
    for r in rows:
        held[r[0]] = np.array([float(r[1].get(s, 0)) for s in subjects])
        total += held[r[0]]
    prior = total / total.sum()
    return {s: np.log((c + 10 * prior) / (c.sum() + 10) / prior) for s, c in held.items()}


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = 3) -> DataFrame:
    """(doc_id, subject), a row for each subject of each document.

    documents: (doc_id, text, source); labels: (doc_id, subject), some of them wrong or missing; labels that
    are null or not in subjects, a table of a few rows, are ignored. Null and blank texts and texts
    without an informative sentence (signs, encoded data) have no subject; any other has at least one.
    Without any label nothing can be told and the result is empty. A repeated doc_id gives its rows again. The
    model is made while this is called.
    """
    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect())
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("subject", T.StringType())]))
    if not names:
        return empty
    given = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("labels")).withColumnRenamed("doc_id", "l_id")
    parsed = read_texts(spread(documents.select("doc_id", "text", "source")))
    docs = written(parsed.join(given, F.col("doc_id") == F.col("l_id"), "left").drop("l_id"), "subjects-read")
    labelled = docs.where("labels IS NOT NULL")
    terms = _count(labelled, names, None)
    if not len(terms.keys):
        return empty
    for _ in range(rounds - 1):
        terms = _count(docs, names, spark.sparkContext.broadcast(terms))  # bounded by TERM_SHARE
    sample = sampled(labelled, "doc_id", MOST_LABELLED)
    held = spark.sparkContext.broadcast((terms, _source_rows(sample, names)))
    none = np.zeros(len(names))

    def described(batch: pa.RecordBatch, own: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first document, whether each can be told, features of those) by slices."""
        model, of_source = held.value
        sources = batch.column(batch.schema.get_field_index("source")).to_pylist()
        for first, read in Read.slices(batch):
            n = len(read.parts)
            share, total = model.shares(read, None if own is None else own[first : first + n])
            rows = np.stack([of_source.get(s, none) for s in sources[first : first + n]])
            yield first, total > 0, _features(share, total, read, rows)[total > 0]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _label_rows(batch, names)
            for first, told, x in described(batch, own):
                y = own[first : first + len(told)][told] > 0
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y.astype(float).tolist(), pa.list_(pa.float64()))], names=["x", "y"])

    rows = sample.select("source", "lang", "sizes", "counts", "terms", "labels").mapInArrow(describe, "x array<double>, y array<double>").collect()  # a bounded sample
    if not rows:
        return empty
    rows.sort(key=lambda r: r[0])  # alike in any order of tasks
    chain = Chain.fitted(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, told, x in described(batch, None):
                if told.any():
                    row, subject = np.nonzero(chain.decode(x))
                    ids = batch.column(0).take(pa.array(first + np.flatnonzero(told)[row]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([names[s] for s in subject])], names=["doc_id", "subject"])

    return docs.select("doc_id", "source", "lang", "sizes", "counts", "terms").mapInArrow(decide, empty.schema)


def composition(assigned: DataFrame) -> DataFrame:
    """(subject, docs, share): documents of each subject, and their share of all (document, subject) rows."""
    n = assigned.groupBy("subject").agg(F.count("*").alias("docs"))
    return n.withColumn("share", F.col("docs") / F.sum("docs").over(Window.partitionBy()))  # a row for each subject
