"""Answers of search sources as payload columns, parsed into hits.

Each parser takes (task_id, payload) and gives (task_id, pos, title, url, snippet); rows without a title or url are
left out, an unreadable payload gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.texts import one_line
from gleanwork.functions.urls import unwrap_redirect
from gleanwork.operators.articles import NO_NEST, VOID
from gleanwork.operators.fetching import status_error
from gleanwork.values import SKIPPED_TEMPLATES, VERIFICATION_MARKS


def _hits(payloads: DataFrame, rows: Column, title: str, url: str, snippet: Column) -> DataFrame:
    """rows: an array of structs; title and url: fields of them; snippet: an expression over `r`."""
    listed = payloads.select("task_id", F.posexplode(rows).alias("pos", "r"))
    out = listed.select("task_id", "pos", F.col(f"r.{title}").alias("title"), F.col(f"r.{url}").alias("url"), snippet.alias("snippet"))
    return out.where("title <> '' AND url <> ''")


def web_json(payloads: DataFrame) -> DataFrame:
    """{"web": {"results": [{title, url, description}]}}."""
    schema = "struct<web:struct<results:array<struct<title:string,url:string,description:string>>>>"
    return _hits(payloads, F.from_json("payload", schema)["web"]["results"], "title", "url", F.col("r.description"))


def organic_json(payloads: DataFrame) -> DataFrame:
    """{"organic_results": [{title, link, snippet}]}; a payload with an error gives no row."""
    schema = "struct<error:string,organic_results:array<struct<title:string,link:string,snippet:string>>>"
    read = F.from_json("payload", schema)
    return _hits(payloads.where(read["error"].isNull()), read["organic_results"], "title", "link", F.col("r.snippet"))


def pages_json(payloads: DataFrame) -> DataFrame:
    """{"webpages": [{title, link, snippet}]}."""
    schema = "struct<webpages:array<struct<title:string,link:string,snippet:string>>>"
    return _hits(payloads, F.from_json("payload", schema)["webpages"], "title", "link", F.col("r.snippet"))


def highlights_json(payloads: DataFrame) -> DataFrame:
    """{"results": [{title, url, highlights: [...]}]}; the snippet joins the highlights."""
    schema = "struct<results:array<struct<title:string,url:string,highlights:array<string>>>>"
    return _hits(payloads, F.from_json("payload", schema)["results"], "title", "url", F.array_join("r.highlights", " "))


def repositories_json(payloads: DataFrame) -> DataFrame:
    """{"items": [{full_name, html_url, description, language, stargazers_count}]}; snippet `[language] description (N stars)`."""
    schema = "struct<items:array<struct<full_name:string,html_url:string,description:string,language:string,stargazers_count:bigint>>>"
    r = F.col("r")
    language = F.when(F.coalesce(r["language"], F.lit("")) != "", F.concat(F.lit("["), r["language"], F.lit("] "))).otherwise(F.lit(""))
    snippet = F.concat(language, F.coalesce(r["description"], F.lit("")), F.lit(" ("), F.coalesce(r["stargazers_count"], F.lit(0)).cast("string"), F.lit(" stars)"))
    return _hits(payloads, F.from_json("payload", schema)["items"], "full_name", "html_url", snippet)


def questions_json(payloads: DataFrame) -> DataFrame:
    """{"items": [{title, link, tags, score, answer_count, is_answered}]}; snippet `tags | Score: n | k answers`; a payload with an error_id gives no row."""
    schema = "struct<error_id:bigint,items:array<struct<title:string,link:string,tags:array<string>,score:bigint,answer_count:bigint,accepted_answer_id:bigint>>>"
    r, read = F.col("r"), F.from_json("payload", schema)
    n = F.coalesce(r["answer_count"], F.lit(0))
    answers = F.when(n == 0, F.lit("unanswered")).otherwise(F.concat(n.cast("string"), F.lit(" answers"), F.when(r["accepted_answer_id"].isNotNull(), F.lit(" (accepted)")).otherwise(F.lit(""))))
    snippet = F.concat_ws(" | ", F.array_join(F.slice(r["tags"], 1, 4), ", "), F.concat(F.lit("Score: "), F.coalesce(r["score"], F.lit(0)).cast("string")), answers)
    return _hits(payloads.where(F.coalesce(read["error_id"], F.lit(0)) == 0), read["items"], "title", "link", snippet)


def feed_xml(payloads: DataFrame) -> DataFrame:
    """An Atom feed; the snippet is `authors — summary`, of more than three authors the first three and et al."""
    schema = "struct<entry:array<struct<title:string,summary:string,author:array<struct<name:string>>,link:array<struct<_href:string,_rel:string>>>>>"
    r = F.col("r")
    names = F.transform(r["author"], lambda a: a["name"])
    authors = F.when(F.size(names) > 3, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join(names, ", "))
    rows = F.transform(F.from_xml("payload", schema, {"mode": "PERMISSIVE"})["entry"], lambda e: e)
    listed = payloads.select("task_id", F.posexplode(rows).alias("pos", "r"))
    alternate = F.get(F.filter(r["link"], lambda x: x["_rel"] == "alternate"), F.lit(0))["_href"]
    snippet = F.concat_ws(" — ", F.nullif(authors, F.lit("")), one_line(r["summary"]))
    out = listed.select("task_id", "pos", one_line(r["title"]).alias("title"), F.coalesce(alternate, F.get(r["link"], F.lit(0))["_href"]).alias("url"), snippet.alias("snippet"))
    return out.where("title <> '' AND url <> ''")


class _Element:
    __slots__ = ("tag", "attributes", "classes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: "_Element | None"):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.classes, self.children = attributes.get("class", "").split(), []

    def walk(self) -> Iterator["_Element"]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, _Element)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                stack += reversed(e.children)
        return "".join(out).strip()

    def first(self, *tests) -> "_Element | None":
        """The first element below that fits the last test, within one that fits the test before it, and so on."""
        for e in self.walk():
            if e is not self and tests[-1](e) and (len(tests) == 1 or e.within(tests[:-1], self)):
                return e
        return None

    def within(self, tests, top: "_Element") -> bool:
        e = self.parent
        while e is not None and e is not top:
            if tests[-1](e):
                return len(tests) == 1 or e.within(tests[:-1], top)
            e = e.parent
        return False


class _Tree(HTMLParser):
    """The elements of a page of results."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in NO_NEST and self.at.tag == tag:
            self.at = self.at.parent
        e = _Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


_tag = lambda name: lambda e: e.tag == name
_of_class = lambda name: lambda e: name in e.classes


def _parsed_pages(payloads: DataFrame, rows_of) -> DataFrame:
    """rows_of gives (pos, title, url, snippet) of the tree of a page; an empty page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                tree = _Tree()
                tree.feed(page or "")
                found = list(rows_of(tree.root))
                at += [i] * len(found)
                rows += found
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["task_id", "pos", "title", "url", "snippet"]
            )

    kind = payloads.schema["task_id"].dataType.simpleString()
    out = payloads.select("task_id", "payload").mapInArrow(run, f"task_id {kind}, pos int, title string, url string, snippet string")
    return out.where("title <> '' AND url <> ''")


def result_page(payloads: DataFrame, block: str = "result", without: str = "result--ad", snippet: str = "snippet") -> DataFrame:
    """An HTML page of results: elements of class block but not without, their first link and element of class snippet.

    Redirect links are unwrapped; numbering counts all blocks.
    """

    def rows_of(root: _Element):
        blocks = [e for e in root.walk() if block in e.classes]
        for pos, e in enumerate(blocks):
            link, text = e.first(_tag("a")), e.first(_of_class(snippet))
            if without not in e.classes and link is not None:
                yield pos, link.text(), link.attributes.get("href", "").strip(), text.text() if text is not None else ""

    return _parsed_pages(payloads, rows_of).withColumn("url", unwrap_redirect(F.col("url")))


def listed_page(payloads: DataFrame) -> DataFrame:
    """An HTML page that lists results as items of class b_algo in the ordered list b_results: the link of their heading, and the caption's or else the first paragraph."""

    def rows_of(root: _Element):
        listed = root.first(lambda e: e.tag == "ol" and e.attributes.get("id") == "b_results")
        items = [e for e in listed.walk() if e.tag == "li" and "b_algo" in e.classes] if listed is not None else []
        for pos, e in enumerate(items):
            link, caption, paragraph = e.first(_tag("h2"), _tag("a")), e.first(_of_class("b_caption"), _tag("p")), e.first(_tag("p"))
            if link is not None:
                yield pos, link.text(), link.attributes.get("href", "").strip(), caption.text() if caption is not None and caption.text() else paragraph.text() if paragraph is not None else ""

    return _parsed_pages(payloads, rows_of)


def container_page(payloads: DataFrame) -> DataFrame:
    """An HTML page of results in containers of class c-container, but not of a template without results.

    The url is the container's attribute mu, else the link of its heading; the snippet is the abstract, else the clamped
    lines, else the old abstract. A page that asks for verification gives no row; verification_asked tells.
    """

    def rows_of(root: _Element):
        containers = [e for e in root.walk() if e.tag == "div" and "c-container" in e.classes]
        for pos, e in enumerate(containers):
            link = e.first(lambda x: x.tag == "h3" and "t" in x.classes, _tag("a")) or e.first(_tag("h3"), _tag("a"))
            if e.attributes.get("tpl", "") in SKIPPED_TEMPLATES or link is None or not link.attributes.get("href"):
                continue
            found = (e.first(lambda x: x.attributes.get("data-module") == "abstract"), e.first(lambda x: "cu-line-clamp" in x.attributes.get("class", "")), e.first(lambda x: x.tag == "div" and "c-abstract" in x.classes))
            texts = [x.text() for x in found if x is not None]
            yield pos, link.text(), e.attributes.get("mu") or link.attributes["href"].strip(), next((t for t in texts if t), "")

    return _parsed_pages(payloads.where(~verification_asked(F.coalesce("payload", F.lit("")))), rows_of)


def verification_asked(page: Column) -> Column:
    """Whether a page asks for verification instead of listing results."""
    out = F.lit(False)
    for mark in VERIFICATION_MARKS:
        out = out | F.contains(page, F.lit(mark))
    return out


def payload_error(payload: Column, status: Column) -> Column:
    """Class of an answer: null if it can be read, else blocked, quota, not_found, transport, unknown by status, `api error` or `verification` by what it says."""
    said = F.from_json(payload, "struct<error:string,error_id:bigint>")
    told = F.when(verification_asked(payload), "verification").when(said["error"].isNotNull() | (F.coalesce(said["error_id"], F.lit(0)) != 0), "api error")
    return F.when(status == 429, "quota").otherwise(F.coalesce(status_error(status), told))
