"""Books to numbered sections."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.functions.html import heading
from groundq.functions.refs import section_filename
from groundq.functions.text import canonical_markdown, short_slug, slug_keep_hyphen
from groundq.operators.retrieve import last_wins
from groundq.shipping import ship


def number_islands(rows: DataFrame, key: str | list[str], order: list[str], value: str) -> DataFrame:
    """island: how often the value has changed up to the row, counted from 1; a leading empty value is an island too."""
    w = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    changed = rows.withColumn("_new", (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value)))
    return changed.withColumn("island", F.sum(F.col("_new").cast("int")).over(w)).drop("_new")


def number_within(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def header_segments(books: DataFrame, *, id: str, text: str, strict: bool = True) -> DataFrame:
    """Sections of markdown books: (id, chapter, chapter_title, section_title, chapter_number, section_number, content).

    A line of one, two or three marks names chapter, chapter title or section title and ends what the deeper ones named. The lines between
    headers, joined, are a section's content; sections without any are left out before numbering. All windows run within one book.
    """
    lines = books.select(F.col(id).alias("_id"), F.posexplode(F.split(canonical_markdown(F.col(text), strict), "\n")).alias("_at", "_line"))
    level = F.length(F.regexp_extract("_line", r"^(#{1,3})\s+\S", 1))
    w = W.partitionBy("_id").orderBy("_at")
    lines = lines.withColumn("_level", level).withColumn("_title", F.trim(F.regexp_replace("_line", r"^#{1,3}\s+", "")))
    lines = lines.withColumn("_part", F.sum((F.col("_level") > 0).cast("int")).over(w))
    names = ["chapter", "chapter_title", "section_title"]
    for n, name in enumerate(names, 1):
        at = F.when(F.col("_level") == n, F.struct("_at", "_title"))
        above = F.last(F.when((F.col("_level") > 0) & (F.col("_level") < n), F.col("_at")), ignorenulls=True).over(w)
        own = F.last(at, ignorenulls=True).over(w)
        lines = lines.withColumn(name, F.when(above.isNull() | (own["_at"] > above), own["_title"]))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_level") == 0, F.struct("_at", "_line")))), lambda x: x["_line"]), "\n")
    parts = lines.groupBy("_id", "_part").agg(*(F.max(n).alias(n) for n in names), F.trim(F.btrim(body, F.lit("\n "))).alias("content")).where("content <> ''")
    parts = parts.withColumns({"chapter": F.coalesce("chapter", F.lit("")), "chapter_title": F.coalesce("chapter_title", F.lit("")), "section_title": F.coalesce("section_title", F.lit("no_title"))})
    numbered = number_within(number_islands(parts, "_id", ["_part"], "chapter"), ["_id", "island"], ["_part"])
    return numbered.select(F.col("_id").alias(id), *names, F.col("island").alias("chapter_number"), F.col("ordinal").alias("section_number"), "content")


def _folded(text: str, joint: str) -> str:
    """Entities resolved, lines (of any kind of break) trimmed and joined, blank ones left out."""
    lines = html.unescape(re.sub("[\u2028\u2029]|\r\n?", "\n", text).lstrip("\ufeff")).split("\n")
    return joint.join(line for line in (re.sub(r"[ \t]+", " ", x).strip() for x in lines) if line)


def paragraph(text: str) -> str:
    return _folded(text, " ")


def one_line(text: str) -> str:
    return " ".join(_folded(text, " ").split())


class _Sections(HTMLParser):
    """Collects (container number, container title, section title, paragraph) in document order.

    A paragraph that opens while another is open starts anew and the open one is lost; one that is open when the container ends is kept.
    A container counts once it is closed: one that the page leaves open, or that another container replaces, gives nothing.
    """

    def __init__(self, container: str, container_class: str | None, title: str, section: str, block: str):
        super().__init__(convert_charrefs=False)
        self.tags, self.css = (container, title, section, block), container_class
        self.found: list[tuple] = []
        self.rows: list[list] = []  # of the open container
        self.depth, self.number, self.open, self.kept = 0, 0, "", {}
        self.title, self.section, self.part = "", "No Title", 0

    def handle_starttag(self, tag, attrs):
        container, title, section, block = self.tags
        if tag == container and (self.css is None and not self.depth or self.css is not None and dict(attrs).get("class") == self.css):
            self.depth, self.number, self.rows = 1, self.number + 1, []
            self.title, self.section, self.part, self.kept = "", "No Title", 0, {}
            return
        if not self.depth:
            return
        if tag == container:
            self.depth += 1
        elif tag in (title, section, block):
            self.kept[tag] = []
            if tag == section:
                self.section, self.part = "No Title", self.part + 1
        elif tag == "br" and (now := self._heading()):
            self.kept[now].append("\n")

    def _heading(self) -> str:
        return next((t for t in self.tags[1:3] if t in self.kept), "")

    def handle_endtag(self, tag):
        container, title, section, block = self.tags
        if not self.depth:
            return
        if tag == container:
            self.depth -= 1
            if not self.depth:
                self._paragraph()
                self.found += [(self.number, self.title, *row) for row in self.rows]
        elif tag == title and tag in self.kept:
            self.title = one_line("".join(self.kept.pop(tag)))
        elif tag == section and tag in self.kept:
            self.section = one_line("".join(self.kept.pop(tag))) or "No Title"
        elif tag == block:
            self._paragraph()

    def _paragraph(self):
        if text := paragraph("".join(self.kept.pop(self.tags[3], []))):
            self.rows.append([self.part, self.section, text])

    def handle_data(self, data):
        if self.depth and (now := self._heading() or (self.tags[3] if self.tags[3] in self.kept else "")):
            self.kept[now].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def html_segments(pages: DataFrame, *, id: str, html: str, container: str = "div", container_class: str | None = "chapter", title: str = "h2", section: str = "h3", block: str = "p") -> DataFrame:
    """Sections of HTML books: (id, chapter_number, chapter_title, section_number, section_title, content), paragraphs between blank lines.

    Sections without a paragraph are left out before numbering, and containers that are never closed, or are replaced by another one that
    opens within them, altogether. chapter_number counts containers, also those left out. The tokenizer is Python's, a page at a time within Arrow batches.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, page in zip(f["_id"], f["_html"], strict=True):
                parser = _Sections(container, container_class, title, section, block)
                parser.feed((page or "").replace("\r\n", "\n").replace("\r", "\n"))
                rows += [(key, *r, n) for n, r in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["_id", "chapter", "chapter_title", "part", "section_title", "text", "n"])

    ship(pages.sparkSession)
    kind = dict(pages.dtypes)[id]
    schema = f"_id {kind}, chapter int, chapter_title string, part int, section_title string, text string, n int"
    found = pages.select(F.col(id).alias("_id"), F.col(html).alias("_html")).mapInPandas(parse, schema)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n")
    parts = found.groupBy("_id", "chapter", "part").agg(F.max("chapter_title").alias("chapter_title"), F.max_by("section_title", "n").alias("section_title"), body.alias("content"))
    numbered = number_within(parts, ["_id", "chapter"], ["part"])
    return numbered.select(F.col("_id").alias(id), F.col("chapter").alias("chapter_number"), F.nullif("chapter_title", F.lit("")).alias("chapter_title"), F.col("ordinal").alias("section_number"), "section_title", "content")


def sections_from_html(pages: DataFrame, *, id: str, html: str, book: str, number: int, book_title: str, **tags) -> DataFrame:
    """The section files of an HTML book: (id, filename, text, chapter, section).

    A chapter's heading gives its number (0 if it has none) and title (No Title), the sections are numbered within it, and both titles go
    into the file name, shortened. The text ends in a line feed. Of sections with one file name the last of the document stays.
    """
    found = html_segments(pages, id=id, html=html, **tags).withColumn("h", heading(F.coalesce("chapter_title", F.lit(""))))
    chapter, named = F.coalesce("h.number", F.lit(0)).cast("int"), lambda c: short_slug(slug_keep_hyphen(c))
    name = section_filename(F.lit(book), F.lit(number), F.lit(book_title), chapter, named(F.coalesce("h.title", F.lit("No Title"))), F.col("section_number"), named(F.col("section_title")))
    rows = found.select(F.col(id), name.alias("filename"), F.concat("content", F.lit("\n")).alias("text"), chapter.alias("chapter"), F.col("section_number").alias("section"), "chapter_number")
    return last_wins(rows, [id, "filename"], ["chapter_number", "section"], ["text", "chapter", "section"])
