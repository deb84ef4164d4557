"""Chapter and section coordinates in file names and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundq.config import REFERENCE_LABEL
from groundq.functions.text import line_feeds, strip, title_from_slug, without_reference


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group), F.lit(""))


# How file names and readable references carry chapter and section.
FULL, CHAPTER = r"(?id)_ch_(\d{1,2}).*?_s(\d{1,2})_", r"(?id)_ch_(\d{1,2})_"
REF = r"(?id)Ch\.\s*(\d{1,2}).*?§\s*(\d{1,2})"


def file_coordinates(filename: Column) -> Column:
    """struct(chapter, section), both or neither."""
    return F.struct(_int(_group(filename, FULL, 1)).alias("chapter"), _int(_group(filename, FULL, 2)).alias("section"))


def file_coordinates_or_chapter(filename: Column) -> Column:
    """The same, or else the chapter alone."""
    chapter = F.coalesce(_group(filename, FULL, 1), _group(filename, CHAPTER, 1))
    return F.struct(_int(chapter).alias("chapter"), _int(_group(filename, FULL, 2)).alias("section"))


def ref_coordinates(ref: Column) -> Column:
    """struct(chapter, section) of a readable reference; both null if it lacks either."""
    return F.struct(_int(_group(ref, REF, 1)).alias("chapter"), _int(_group(ref, REF, 2)).alias("section"))


def readable_ref(filename: Column, label: Column | str) -> Column:
    """"Label, Ch. n — Title, §m — Title" of a section's file name, without the section if there is none, or else the name itself."""
    label = F.lit(label) if isinstance(label, str) else label
    base = F.regexp_replace(strip(filename), r"\.[A-Za-z0-9]+$", "")
    full, short = r"(?id)_ch_(\d{1,2})_(.+?)_s(\d{1,2})_(.+)$", r"(?id)_ch_(\d{1,2})_(.+)$"

    def part(pattern: str, number: int, mark: str) -> Column:
        return F.concat(F.lit(mark), _int(_group(base, pattern, number)).cast("string"), F.lit(" — "), title_from_slug(F.regexp_extract(base, pattern, number + 1)))

    whole = F.concat(label, F.lit(", "), part(full, 1, "Ch. "), F.lit(", "), part(full, 3, "§"))
    chapter = F.concat(label, F.lit(", "), part(short, 1, "Ch. "))
    return F.when(base.rlike(full), whole).when(base.rlike(short), chapter).otherwise(strip(filename))


def strip_ref(line: Column) -> Column:
    """A line without the "Label, Ch. n ..." at its end."""
    return without_reference(line, REFERENCE_LABEL)


def section_filename(book: Column, number: Column, title: Column, chapter: Column, chapter_title: Column, section: Column, section_title: Column) -> Column:
    two = lambda c: F.format_string("%02d", c)
    return F.concat_ws("_", book, F.concat(F.lit("book"), two(number)), title, F.lit("ch"), two(chapter), chapter_title, F.concat(F.lit("s"), two(section)), F.concat(section_title, F.lit(".txt")))


#: Fixed value: a citation marker.
MARKER = r"【\d+:\d+†([^】]+)】"


def marker_files(text: Column) -> Column:
    """Distinct file names of citation markers, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKER), F.lit(1))))


def answer_items(answer: Column) -> Column:
    """array of struct(quote, ref): blocks between blank lines, the first line apart."""
    blocks = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n\n"), strip), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(strip(F.substring_index(b, "\n", 1)).alias("quote"), strip(F.regexp_replace(b, r"(?s)^[^\n]*\n?", "")).alias("ref")),
    )


def reformat_answer(raw: Column, label: str = "Source") -> Column:
    """A model's free text as "quote\\nreference" blocks.

    Lines up to a verified-sources block are read in order. A blank line ends an item, a line that starts with a quotation mark starts one,
    a marker or a line that is a file name names the item's file. Expressed as one fold over the lines.
    """
    text = F.element_at(F.split(raw, r"(?is)\n\s*SOURCES\s*\(verified\)"), 1)
    text = F.regexp_replace(strip(line_feeds(F.regexp_replace(text, r"(?m)^\s*-{10,}\s*$", ""))), "\n{3,}", "\n\n")
    lines = F.concat(F.transform(F.split(text, "\n"), strip), F.array(F.lit("")))
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("items"), F.lit("").alias("quote"), none.alias("file"))

    def item(s: Column) -> Column:
        quote = strip_ref(s["quote"])
        block = F.when(s["file"].isNotNull(), F.concat_ws("\n", quote, readable_ref(s["file"], label))).otherwise(quote)
        return F.when(quote == "", s["items"]).otherwise(F.concat(s["items"], F.array(block)))

    def step(s: Column, line: Column) -> Column:
        marked = F.nullif(strip(F.regexp_extract(line, MARKER, 1)), F.lit(""))
        rest = strip(F.regexp_replace(line, MARKER, ""))
        file = F.coalesce(marked, s["file"])
        is_file = rest.rlike(r"(?i)^[a-z0-9][a-z0-9._-]*\.(txt|md|pdf)$")
        opens = rest.startswith('"') & (s["quote"] != "")
        joined = F.when(s["quote"] == "", rest).otherwise(F.concat(s["quote"], F.lit(" "), rest))
        # a quotation that opens the next item takes the file named on its own line with it only if the item before had none open
        flushed = F.struct(item(F.struct(s["items"], s["quote"], file.alias("file"))).alias("items"), rest.alias("quote"), none.alias("file"))
        return (
            F.when(line == "", F.struct(item(s).alias("items"), F.lit("").alias("quote"), none.alias("file")))
            .when(is_file, F.struct(s["items"].alias("items"), s["quote"].alias("quote"), rest.alias("file")))
            .when(opens, flushed)
            .otherwise(F.struct(s["items"].alias("items"), joined.alias("quote"), file.alias("file")))
        )

    return F.array_join(F.aggregate(lines, start, step, lambda s: s["items"]), "\n\n")
