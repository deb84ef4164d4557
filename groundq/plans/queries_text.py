"""Scalar functions over whole tables, and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundq.functions import refs, text
from groundq.functions.html import heading, one_line
from groundq.operators.segment import header_segments as segment_headers
from groundq.operators.segment import html_segments as segment_html
from groundq.operators.segment import sections_from_html as sections_of_html
from groundq.plans.views import SECTIONS, folded, matched, sections, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


COORDS = "CAST(nullif(regexp_extract({0}, '_ch_(\\d{{1,2}}).*?_s(\\d{{1,2}})_', {1}), '') AS INTEGER)"
#: Every third section under a file name without a section.
NAMES = f"{SECTIONS}, names AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b_ch_' || lpad(CAST(chapter AS VARCHAR), 2, '0') || '_of_the_state.txt' ELSE filename END AS f FROM sections)"
TITLE = "array_to_string(list_transform(list_filter(string_split({0}, '_'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _names(spark, d):
    short = F.concat(F.lit("b_ch_"), F.format_string("%02d", "chapter"), F.lit("_of_the_state.txt"))
    return sections(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, short).otherwise(F.col("filename")).alias("f"))


@query(f"WITH {NAMES} SELECT doc_id, {COORDS.format('f', 1)} AS chapter, {COORDS.format('f', 2)} AS section FROM names")
def ch_sec_strict(spark, d):
    return _names(spark, d).select("doc_id", refs.file_coordinates(F.col("f")).alias("c")).select("doc_id", "c.*")


@query(f"WITH {NAMES} SELECT doc_id, coalesce({COORDS.format('f', 1)}, CAST(nullif(regexp_extract(f, '_ch_(\\d{{1,2}})_', 1), '') AS INTEGER)) AS chapter, {COORDS.format('f', 2)} AS section FROM names")
def ch_sec_fallback(spark, d):
    return _names(spark, d).select("doc_id", refs.file_coordinates_or_chapter(F.col("f")).alias("c")).select("doc_id", "c.*")


_BASE = "regexp_replace(f, '\\.[A-Za-z0-9]+$', '')"
_FULL = "'_ch_(\\d{1,2})_(.+?)_s(\\d{1,2})_(.+)$'"
_SHORT = "'_ch_(\\d{1,2})_(.+)$'"
REFS = f"""{NAMES}, refs AS (SELECT doc_id, CASE
  WHEN regexp_matches({_BASE}, {_FULL}) THEN 'Source, Ch. ' || CAST(regexp_extract({_BASE}, {_FULL}, 1) AS INTEGER) || ' — ' || {TITLE.format(f"regexp_extract({_BASE}, {_FULL}, 2)")}
    || ', §' || CAST(regexp_extract({_BASE}, {_FULL}, 3) AS INTEGER) || ' — ' || {TITLE.format(f"regexp_extract({_BASE}, {_FULL}, 4)")}
  WHEN regexp_matches({_BASE}, {_SHORT}) THEN 'Source, Ch. ' || CAST(regexp_extract({_BASE}, {_SHORT}, 1) AS INTEGER) || ' — ' || {TITLE.format(f"regexp_extract({_BASE}, {_SHORT}, 2)")}
  ELSE f END AS ref FROM names)"""


@query(f"WITH {REFS} SELECT doc_id, ref FROM refs")
def pretty_ref(spark, d):
    return _names(spark, d).select("doc_id", refs.readable_ref(F.col("f"), "Source").alias("ref"))


@query(f"WITH {REFS} SELECT doc_id, CAST(nullif(regexp_extract(ref, 'Ch\\.\\s*(\\d{{1,2}}).*?§\\s*(\\d{{1,2}})', 1), '') AS INTEGER) AS chapter, CAST(nullif(regexp_extract(ref, 'Ch\\.\\s*(\\d{{1,2}}).*?§\\s*(\\d{{1,2}})', 2), '') AS INTEGER) AS section FROM refs")
def parse_ref(spark, d):
    ref = refs.readable_ref(F.col("f"), "Source")
    return _names(spark, d).select("doc_id", refs.ref_coordinates(ref).alias("c")).select("doc_id", "c.*")


_LABEL = r"[A-Za-z][\p{L}\p{N}_\s\-]{0,80},\s*"
_CHAPTER = r"(?:Ch\.|Chapter)\s*\d+.*$"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _without(c: str, reference: str) -> str:
    return _stripped(f"regexp_replace({c}, '(?i)\\s+{reference}{_CHAPTER}', '')")


@query("SELECT doc_id, md5(" + _without("text || ' Source, Ch. 13, §5'", _LABEL) + ") AS quote FROM documents")
def strip_ref(spark, d):
    whole = F.concat("text", F.lit(" Source, Ch. 13, §5"))
    return table(spark, d, "documents").select("doc_id", F.md5(refs.strip_ref(whole)).alias("quote"))


_CLEANED = _without(_without("""'"' || text || '" corpus_ch_13_x_s05_y.txt, Ch. 13, §5'""", r"[a-z0-9][a-z0-9._-]*\.(?:txt|md|pdf)\s*,?\s*"), f"(?:{_LABEL})?")


@query(f"""WITH cleaned AS (SELECT doc_id, {_CLEANED} AS q FROM documents)
SELECT doc_id, md5(CASE WHEN length(q) >= 2 AND q[1] IN ('"', '''') AND q[1] = q[-1] THEN {_stripped('q[2:-2]')} ELSE q END) AS quote FROM cleaned""")
def clean_quote(spark, d):
    whole = F.concat(F.lit('"'), "text", F.lit('" corpus_ch_13_x_s05_y.txt, Ch. 13, §5'))
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_quote(whole)).alias("quote"))


@query(f"SELECT doc_id, md5({matched('text')}) AS norm FROM documents")
def norm_match(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.for_match(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id, md5({folded('text')}) AS norm FROM documents")
def norm_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_space(F.col("text"))).alias("norm"))


PART_TITLE = "' ' || p_name || ', (' || p_type || ') ' || p_brand || '-' || p_size || '! '"


def _part(spark, d):
    title = F.concat(F.lit(" "), "p_name", F.lit(", ("), "p_type", F.lit(") "), "p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("! "))
    return table(spark, d, "part").select("p_partkey", title.alias("title"))


@query(f"SELECT p_partkey, trim(regexp_replace(lower(trim({PART_TITLE})), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugify(spark, d):
    return _part(spark, d).select("p_partkey", text.slug(F.col("title")).alias("slug"))


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({PART_TITLE})), '[^a-z0-9\\-\\s]+', '', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM part")
def slug_keep_hyphen(spark, d):
    return _part(spark, d).select("p_partkey", text.slug_keep_hyphen(F.col("title")).alias("slug"))


@query(f"SELECT p_partkey, regexp_replace({PART_TITLE}, '[^a-zA-Z0-9._-]+', '_', 'g')[1:80] AS slug FROM part")
def safe_slug(spark, d):
    return _part(spark, d).select("p_partkey", text.safe_slug(F.col("title")).alias("slug"))


SLUG = "trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"SELECT doc_id, CASE WHEN length(s) > 80 THEN s[1:73] || '_' || md5(s)[1:6] ELSE s END AS slug FROM (SELECT doc_id, {SLUG} AS s FROM documents)")
def slug_shorten_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", text.short_slug(text.slug(F.col("text"))).alias("slug"))


@query(f"WITH {SECTIONS} SELECT doc_id, 'corpus_book01_x_ch_' || lpad(CAST(chapter AS VARCHAR), 2, '0') || '_' || source || '_s' || lpad(CAST(section AS VARCHAR), 2, '0') || '_' || lang || '.txt' AS filename FROM sections")
def filename_build(spark, d):
    name = refs.section_filename(F.lit("corpus"), F.lit(1), F.lit("x"), F.col("chapter"), F.col("source"), F.col("section"), F.col("lang"))
    return sections(spark, d).select("doc_id", name.alias("filename"))


@query("SELECT p_partkey, CAST(p_partkey % 3999 + 1 AS INTEGER) AS value FROM part")
def roman_numeral(spark, d):
    n = F.expr("CAST(p_partkey % 3999 + 1 AS INT)")
    digit = lambda place, one, five, ten: F.element_at(F.lit(["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]), ((n / place).cast("int") % 10 + 1).cast("int"))
    numeral = F.concat(F.expr("repeat('M', CAST((p_partkey % 3999 + 1) div 1000 AS INT))"), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))
    return table(spark, d, "part").select("p_partkey", text.roman(numeral).alias("value"))


@query("SELECT p_partkey, CAST(p_partkey % 39 + 1 AS INTEGER) AS number, upper(p_name) AS title FROM part")
def heading_parse(spark, d):
    tens = F.element_at(F.lit(["", "X", "XX", "XXX"]), F.expr("CAST((p_partkey % 39 + 1) div 10 + 1 AS INT)"))
    ones = F.element_at(F.lit(["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]), F.expr("CAST((p_partkey % 39 + 1) % 10 + 1 AS INT)"))
    line = F.concat(F.lit(" Chapter\n"), tens, ones, F.lit(". "), F.upper("p_name"))
    return table(spark, d, "part").select("p_partkey", heading(one_line(line)).alias("h")).select("p_partkey", "h.*")


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(props ->> 'k' AS BIGINT) END AS k FROM events")
def json_extract(spark, d):
    reply = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done.")))
    reply = reply.when(F.col("event_id") % 4 == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("{"), "props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(text.json_object(reply), "$.k", "bigint").alias("k"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped"))


@query("SELECT doc_id, list_sort(list_distinct(['a_' || lang || '.txt', source || '.md'])) AS files FROM documents")
def marker_files(spark, d):
    raw = F.concat("text", F.lit("【1:0†"), "source", F.lit(".md】 and 【12:3†a_"), "lang", F.lit(".txt】【3:3†"), "source", F.lit(".md】"))
    return table(spark, d, "documents").select("doc_id", refs.marker_files(raw).alias("files"))


@query()
def reformat_answer(spark, d):
    """Whole texts as a model's free text. SQL has no fold over lines; a plain program is compared in the tests."""
    raw = F.concat(F.lit('"'), "text", F.lit('" 【1:0†x_ch_07_of_power.txt】\n"two" 【2:1†a.md】\nwords Source, Ch. 9, §1\nb_ch_08_y_s02_z.txt\n\nSOURCES (verified)\n- file'))
    return table(spark, d, "documents").select("doc_id", F.md5(refs.reformat_answer(raw)).alias("answer"))


@query()
def html_segments(spark, d):
    return segment_html(table(spark, d, "pages"), id="page_id", html="html", container="article", container_class=None, title="h1", section="h2", block="p")


@query("""WITH books AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, 'A' AS chapter, 't' || ((i - 1) // 2) AS chapter_title, 's' || (i - 1) AS section_title, CAST(1 AS BIGINT) AS chapter_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS section_number, md5(trim(l[i])) AS content
FROM books, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""")
def header_segments(spark, d):
    return _headers(spark, d, " ", strict=False)


#: Headers without their space, which the strict form gives them.
@query(SQL["header_segments"])
def header_segments_strict(spark, d):
    return _headers(spark, d, "", strict=True)


@query()
def sections_from_html(spark, d):
    """Section files of pages as books; the numerals and names of chapters come from their headings."""
    tags = {"container": "article", "container_class": None, "title": "h1", "section": "h2", "block": "p"}
    return sections_of_html(table(spark, d, "pages"), id="page_id", html="html", book="pages", number=1, book_title="web", **tags)


def _headers(spark, d, space, strict):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    book = F.transform(
        lines,
        lambda x, i: F.concat(
            F.when(i % 2 == 0, F.concat(F.lit(f"##{space}t"), F.floor(i / 2).cast("string"), F.lit("\n"))).otherwise(F.lit("")), F.lit(f"###{space}s"), i.cast("string"), F.lit("\n"), x
        ),
    )
    books = table(spark, d, "documents").select("doc_id", F.concat(F.lit(f"#{space}A\n"), F.array_join(book, "\n")).alias("book"))
    return segment_headers(books, id="doc_id", text="book", strict=strict).withColumn("content", F.md5("content"))
