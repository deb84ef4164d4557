"""Quotations, answers and the metrics of tests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.config import REFUSAL_TEXT
from groundq.functions.numbers import number
from groundq.operators import metrics, quotes
from groundq.operators.evaluation import evaluate
from groundq.operators.pipeline import run_pipeline
from groundq.operators.retrieve import snippet
from groundq.plans.views import POOL, QUOTATIONS, SECTIONS, TOPK, folded, matched, pool, questions, quotations, sections, table, texts, topk

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def words(c: str) -> str:
    return f"list_distinct(regexp_extract_all({matched(c)}, '[\\p{{L}}\\p{{N}}]+'))"


def sentences(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {stripped('x')}), lambda x: x <> '')"


def extracted(passages: str) -> str:
    """SQL of the sentences of passages (qid, question, rank, filename, passage) that share most words with the question, four at most."""
    return f"""split AS (SELECT qid, rank, filename, {words("question")} AS asked, {sentences("passage")} AS parts FROM {passages} WHERE trim(passage) <> ''),
each AS (SELECT qid, rank, filename, asked, unnest(parts) AS quote, generate_subscripts(parts, 1) AS place FROM split),
scored AS (SELECT *, len(list_intersect(asked, {words("quote")})) AS overlap FROM each),
extracted AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, place) AS INTEGER) AS ord, quote, filename, CAST(overlap AS INTEGER) AS overlap FROM scored WHERE overlap > 0
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, place) <= 4)"""


TITLED = "array_to_string(list_transform(list_filter(string_split(source, '_'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
#: Questions: the first sentence of every hundredth embedding's document. Passages: the documents of the eight best chunks.
RUN = f"""WITH {TOPK}, asked_of AS (
  SELECT doc_id AS qid, {stripped("CASE WHEN regexp_matches(text, '(?s)^\\s*.*?[.!?]\\s') THEN regexp_extract(text, '(?s)^\\s*(.*?[.!?])\\s', 1) ELSE text END")} AS question FROM documents),
questions AS (SELECT vec_id AS qid, question FROM embeddings LEFT JOIN asked_of ON qid = vec_id WHERE vec_id % 100 = 0),
found AS (SELECT t.qid, t.rank, t.score, question, 'corpus_book01_x_ch_01_' || source || '_s01_' || doc_id || '.txt' AS filename, 'Source, Ch. 1 — ' || {TITLED} || ', §1 — ' || doc_id AS ref, text AS passage
  FROM topk t JOIN documents ON doc_id = vec_id JOIN questions q USING (qid)),
selected AS (SELECT * FROM found WHERE rank <= 8), {extracted("selected")},
shown AS (SELECT DISTINCT e.qid, e.ord, e.quote, e.filename, s.ref FROM extracted e JOIN selected s USING (qid, filename)),
answers AS (SELECT q.qid, coalesce(final, '{REFUSAL_TEXT}') AS final_answer, final IS NULL AS refused, coalesce(files, []) AS files, coalesce(n_quotes, 0) AS n_quotes FROM questions q LEFT JOIN (
  SELECT qid, string_agg(quote || chr(10) || ref, chr(10) || chr(10) ORDER BY ord) AS final, list_sort(list(DISTINCT filename)) AS files, count(*) AS n_quotes FROM shown GROUP BY qid) USING (qid))"""


def _run(spark, d):
    docs = texts(spark, d).select(F.col("doc_id").alias("vec_id"), F.col("text").alias("passage"), "source")
    found = topk(spark, d).join(docs, "vec_id").withColumn("filename", F.concat(F.lit("corpus_book01_x_ch_01_"), "source", F.lit("_s01_"), F.col("vec_id").cast("string"), F.lit(".txt")))
    asked = questions(spark, d).select("qid").join(docs.select(F.col("vec_id").alias("qid"), quotes.first_sentence(F.col("passage")).alias("question")), "qid", "left")
    named = found.select("qid", "rank", "filename", "score", "passage")
    return asked, docs, run_pipeline(asked, named, named.select("filename", F.col("passage").alias("text")).dropDuplicates(["filename"]))


@query(f"{RUN} SELECT qid, final_answer, refused, files FROM answers")
def answer(spark, d):
    """Every hundredth embedding asks with its document's first sentence; passages are the documents of the pool's chunks."""
    return _run(spark, d)[2].answers


@query(f"""{RUN}, pools AS (SELECT qid, count(DISTINCT filename) AS pool_files, count(DISTINCT filename) FILTER (rank <= 8) AS used_files, max(rank) FILTER (rank <= 8) AS max_rank,
  string_agg(rank || ':' || printf('%.4f', score), ',' ORDER BY rank) FILTER (rank <= 8) AS used_ranks, count(*) AS view_rows FROM found GROUP BY qid)
SELECT qid, md5(final_answer) AS final_answer, NOT refused AS audit_passed, pool_files, used_files, used_files AS used_in_pool, CAST(1 AS DOUBLE) AS coverage_ratio, max_rank, '1' AS retrieval_chapters, '1' AS used_chapters, used_ranks,
  n_quotes, view_rows, CASE WHEN refused THEN 8 ELSE 7 END AS n_events FROM answers JOIN pools USING (qid)""")
def pipeline_answer(spark, d):
    """All that a run leaves behind, counted: answer, audit, coverage, summary, quotes, selection view and trace rows."""
    run = _run(spark, d)[2]
    counted = lambda rows, name: rows.groupBy("qid").agg(F.count("*").alias(name))
    out = run.answers.select("qid", F.md5("final_answer").alias("final_answer")).join(run.meta.select("qid", "audit_passed"), "qid")
    out = out.join(run.summary.select("qid", "pool_files", "used_files", "used_in_pool", "coverage_ratio", "max_rank", "retrieval_chapters", "used_chapters", "used_ranks"), "qid")
    out = out.join(counted(run.quotes, "n_quotes"), "qid", "left").join(counted(run.view, "view_rows"), "qid").join(counted(run.events, "n_events"), "qid")
    return out.withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0)))


#: Every third question must be refused; three of four expect the one section that all files of this corpus have.
@query(f"""{RUN}, last AS (SELECT qid, arg_max(passage, rank) AS text FROM selected GROUP BY qid),
graded AS (SELECT s.qid, q.qid % 400 <> 0 AS expects, floor(5.0 * len(list_intersect({words("question")}, {words("quote")})) / greatest(len(list_distinct(list_concat({words("question")}, {words("quote")}))), 1)) AS score,
  contains({matched("l.text")}, {matched("quote")}) AS ok FROM shown s JOIN questions q USING (qid) JOIN last l USING (qid)),
per AS (SELECT qid, count(*) AS n, avg(score) AS mean, count(*) FILTER (ok) AS n_ok FROM graded GROUP BY qid),
firsts AS (SELECT qid, min(rank) AS rank, arg_min(score, rank) AS score FROM found GROUP BY qid)
SELECT a.qid, refused AS refusal, refused = (a.qid % 300 = 0) AS refusal_ok, true AS expected_quote_hit, NOT refused AS audit_passed, refused = (a.qid % 300 = 0) AND NOT refused AS pass_all,
  CASE WHEN e THEN 1 END AS expected_total, CASE WHEN e THEN CASE WHEN f.qid IS NULL THEN 0 ELSE 1 END END AS expected_retrieved, CASE WHEN e THEN CASE WHEN f.qid IS NULL THEN 0.0 ELSE 1.0 END END AS retrieval_recall_at_20,
  CASE WHEN e THEN CAST(f.rank AS DOUBLE) END AS retrieval_mean_rank, CASE WHEN e THEN f.score END AS retrieval_mean_score,
  CASE WHEN e THEN CASE WHEN refused THEN 0 ELSE 1 END END AS expected_selected, CASE WHEN e THEN CASE WHEN refused THEN 0.0 ELSE 1.0 END END AS final_recall,
  CASE WHEN e THEN CASE WHEN refused THEN 0 ELSE 1 END END AS final_unique_citations, CASE WHEN e THEN 0 END AS extra_selected_count,
  CASE WHEN NOT e THEN mean END AS extras_mean_relevance, CASE WHEN NOT e THEN coalesce(n, 0) ELSE 0 END AS extras_count_graded,
  CASE WHEN e THEN mean END AS expected_quotes_mean_relevance, CASE WHEN e THEN coalesce(n, 0) ELSE 0 END AS expected_quotes_count_graded, mean AS answers_mean_relevance, coalesce(n, 0) AS answers_count_graded,
  coalesce(n, 0) AS quote_match_checked, coalesce(n_ok, 0) AS quote_match_count, n_ok / n AS quote_match_rate, n_ok = n AS quote_match_all, 0 AS quote_match_missing_source
FROM (SELECT *, qid % 400 <> 0 AS e FROM answers) a LEFT JOIN per USING (qid) LEFT JOIN firsts f USING (qid)""")
def evaluate_suite(spark, d):
    """The 25 metrics of each question as a test."""
    asked, docs, run = _run(spark, d)
    place = F.array(F.struct(F.lit(1).alias("chapter"), F.lit(1).alias("section")))
    tests = asked.withColumns({"must_refuse": F.col("qid") % 300 == 0, "expected": F.when(F.col("qid") % 400 != 0, place), "expected_quotes": F.array().cast("array<string>")})
    return evaluate(tests, run, run.pool.select("filename", F.col("passage").alias("text")).dropDuplicates(["filename"]))


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn AS question_turn, min(a.turn) AS answer_turn, any_value(u.text) AS question, arg_min(a.text, a.turn) AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn > u.turn AND a.role = 'assistant'
  WHERE u.role = 'user' GROUP BY u.conv_id, u.turn)"""


@query(f"""WITH {PAIRS}, passages AS (SELECT conv_id || '-' || question_turn AS qid, question, 1 AS rank, 'c' || conv_id || '.txt' AS filename, answer AS passage FROM pairs), {extracted("passages")}
SELECT * FROM extracted""")
def extract_baseline(spark, d):
    """Questions are the user turns of conversations, passages the answers that follow."""
    pairs = _pairs(spark, d).select(F.concat_ws("-", "conv_id", "question_turn").alias("qid"), "question", F.lit(1).alias("rank"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("answer").alias("passage"))
    return quotes.extract_by_overlap(pairs)


@query(f"""WITH {PAIRS} SELECT conv_id || '-' || question_turn AS qid, 'turn ' || answer_turn AS ref,
  CAST(floor(5.0 * len(list_intersect({words("question")}, {words("answer")})) / greatest(len(list_distinct(list_concat({words("question")}, {words("answer")}))), 1)) AS INTEGER) AS score FROM pairs""")
def grade_baseline(spark, d):
    pairs = _pairs(spark, d)
    keyed = pairs.withColumn("qid", F.concat_ws("-", "conv_id", "question_turn"))
    return quotes.grade_by_overlap(keyed.select("qid", "question"), keyed.select("qid", F.concat(F.lit("turn "), F.col("answer_turn").cast("string")).alias("ref"), F.col("answer").alias("quote")))


def _pairs(spark, d):
    """Each user turn with the first assistant turn after it: the last one seen when the conversation is read backwards, not a join."""
    after = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    reply = F.last(F.when(F.col("role") == "assistant", F.struct("turn", "text")), ignorenulls=True).over(after)
    rows = table(spark, d, "conversations").withColumn("reply", reply).where("role = 'user' AND reply IS NOT NULL")
    return rows.select("conv_id", F.col("turn").alias("question_turn"), F.col("reply.turn").alias("answer_turn"), F.col("text").alias("question"), F.col("reply.text").alias("answer"))


@query(f"WITH {PAIRS} SELECT conv_id, question_turn, answer_turn FROM pairs")
def qa_pairs(spark, d):
    return _pairs(spark, d).select("conv_id", "question_turn", "answer_turn")


VERIFIED = f"""{QUOTATIONS}, held AS (
  SELECT q.qid, q.ord, regexp_replace(q.quote, '^\\s+|\\s+$', '', 'g') AS quote, q.filename, row_number() OVER (PARTITION BY q.qid ORDER BY q.ord) AS n
  FROM quotations q JOIN (SELECT doc_id AS qid, {matched('text')} AS norm FROM sections WHERE trim(text) <> '') s USING (qid)
  WHERE contains(norm, {matched('q.quote')})),
verified AS (SELECT qid, ord, quote, filename FROM held WHERE n <= 4)"""


def _verified(spark, d):
    passages = sections(spark, d).select(F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), "filename", F.col("text").alias("passage"))
    return quotes.verify(quotations(spark, d), passages)


@query(f"WITH {VERIFIED} SELECT qid, ord, md5(quote) AS quote, filename FROM verified")
def verify_quotes(spark, d):
    return _verified(spark, d).withColumn("quote", F.md5("quote"))


ANSWERS = f"""{VERIFIED}, answers AS (
  SELECT s.doc_id AS qid, coalesce(text2, '{REFUSAL_TEXT}') AS final_answer, text2 IS NULL AS refused, coalesce(n_files, 0) AS n_files FROM sections s LEFT JOIN (
    SELECT qid, string_agg(quote || chr(10) || 'Source, Ch. ' || s.chapter || ' — ' || upper(source[1]) || source[2:] || ', §' || s.section || ' — ' || upper(lang[1]) || lang[2:] || ' ' || s.doc_id, chr(10) || chr(10) ORDER BY ord) AS text2, count(DISTINCT v.filename) AS n_files
    FROM verified v JOIN sections s ON s.doc_id = v.qid WHERE quote <> '' GROUP BY qid) t ON t.qid = s.doc_id)"""


def _answers(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("qid"))
    return quotes.formatted(asked, _verified(spark, d))


@query(f"WITH {ANSWERS} SELECT qid, md5(final_answer) AS final_answer, n_files FROM answers")
def format_answer(spark, d):
    return _answers(spark, d).select("qid", F.md5("final_answer").alias("final_answer"), F.size("files").cast("long").alias("n_files"))


@query(f"WITH {ANSWERS} SELECT qid, refused FROM answers")
def refusal_detect(spark, d):
    return _answers(spark, d).select("qid", quotes.is_refusal(F.concat(F.lit(" \n"), "final_answer", F.lit("\t"))).alias("refused"))


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {matched('text')} AS t FROM documents) JOIN (SELECT item_id, {matched('text')} AS w FROM benchmark) ON w <> '' AND contains(t, w)")
def verbatim_search(spark, d):
    return quotes.verbatim_search(texts(spark, d), table(spark, d, "benchmark"), id="doc_id", text="text", item="item_id", item_text="text")


#: Tests are sources; a document's quotations refer to its chapter and section, whose last document is the file. Sections 20 name a file that is lost.
@query(f"""WITH {QUOTATIONS}, files AS (SELECT source, chapter, section, max(doc_id) AS doc_id FROM sections GROUP BY ALL),
met AS (SELECT s.source AS qid, q.quote, t.text FROM quotations q JOIN sections s ON s.doc_id = q.qid JOIN files f ON f.source = s.source AND f.chapter = s.chapter AND f.section = s.section
  LEFT JOIN documents t ON t.doc_id = f.doc_id AND f.section <> 20 WHERE trim(q.quote) <> '' AND NOT regexp_matches(q.quote, '^\\s*[''"]'))
SELECT qid, count(text) AS quote_match_checked, count(*) FILTER (contains({matched('text')}, {matched('quote')})) AS quote_match_count, count(*) FILTER (text IS NULL) AS quote_match_missing_source,
  count(*) FILTER (contains({matched('text')}, {matched('quote')})) / nullif(count(text), 0) AS quote_match_rate, count(*) FILTER (contains({matched('text')}, {matched('quote')})) = nullif(count(text), 0) AS quote_match_all
FROM met GROUP BY qid""")
def quote_match(spark, d):
    rows = sections(spark, d)
    some = quotations(spark, d).withColumnRenamed("qid", "doc_id").drop("filename", "chapter", "section").join(rows.select("doc_id", "source", "chapter", "section"), "doc_id")
    some = some.where(~F.col("quote").rlike(r"^\s*['\"]")).withColumnRenamed("source", "qid")
    selected = rows.select(F.col("source").alias("qid"), F.col("doc_id").alias("rank"), "chapter", "section", "filename")
    selected = selected.withColumn("filename", F.when(F.col("section") == 20, F.lit("lost.txt")).otherwise(F.col("filename")))
    return metrics.quote_match(some, selected, rows.select("filename", "text"))


def _expected(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return sections(spark, d).join(good, "doc_id", "left_semi").select(F.col("source").alias("qid"), "chapter", "section").distinct()


EXPECTED = f"{SECTIONS}, expected AS (SELECT DISTINCT source AS qid, chapter, section FROM sections WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"


@query(f"WITH {EXPECTED} SELECT s.doc_id FROM sections s WHERE EXISTS (SELECT 1 FROM expected e WHERE e.qid = s.source AND e.chapter = s.chapter AND e.section = s.section)")
def expected_semi(spark, d):
    rows = sections(spark, d).withColumnRenamed("source", "qid")
    return metrics.expected_quotes(rows, _expected(spark, d)).select("doc_id")


@query(f"WITH {EXPECTED} SELECT s.doc_id FROM sections s WHERE doc_id % 11 = 0 OR NOT EXISTS (SELECT 1 FROM expected e WHERE e.qid = s.source AND e.chapter = s.chapter AND e.section = s.section)")
def extras_anti(spark, d):
    rows = sections(spark, d).withColumnRenamed("source", "qid").withColumn("section", F.when(F.col("doc_id") % 11 != 0, F.col("section")))
    return metrics.extra_quotes(rows, _expected(spark, d)).select("doc_id")


#: Expected keys of a question: labelled good documents in its file range; cited: the files of its selected rows and the question's own.
@query(f"""WITH {POOL}, tests AS (SELECT DISTINCT qid FROM pool UNION ALL SELECT -1), expected AS (SELECT DISTINCT qid, doc_id % 100 AS key FROM pool, labels WHERE quality = 1),
first AS (SELECT qid, file AS key, min(rank) AS rank, arg_min(score, rank) AS score FROM pool GROUP BY ALL),
cited AS (SELECT DISTINCT qid, file AS key FROM pool WHERE selected = 'Y'),
hits AS (SELECT e.qid, e.key, f.rank, f.score, c.key AS c FROM expected e LEFT JOIN first f USING (qid, key) LEFT JOIN cited c USING (qid, key)),
each AS (SELECT qid, count(*) AS expected_total, count(rank) AS expected_retrieved, count(rank) / count(*) AS retrieval_recall_at_20, avg(rank) AS retrieval_mean_rank, avg(score) AS retrieval_mean_score, count(c) AS expected_selected, count(c) / count(*) AS final_recall FROM hits GROUP BY qid)
SELECT t.qid, each.* EXCLUDE (qid), CASE WHEN expected_total IS NOT NULL THEN (SELECT count(*) FROM cited c WHERE c.qid = t.qid) END AS final_unique_citations,
  CASE WHEN expected_total IS NOT NULL THEN (SELECT count(*) FROM cited c WHERE c.qid = t.qid) - expected_selected END AS extra_selected_count FROM tests t LEFT JOIN each USING (qid)""")
def recall_metrics(spark, d):
    rows = pool(spark, d)
    tests = rows.select("qid").distinct()
    keys = table(spark, d, "labels").where("quality = 1").select((F.col("doc_id") % 100).alias("key")).distinct()
    expected = tests.join(F.broadcast(keys), F.lit(True))  # a hundred keys at most
    tests = tests.union(spark.range(-1, 0).select("id"))  # and a question that expects nothing
    return metrics.recall_metrics(tests, expected, rows.withColumnRenamed("file", "key"), rows.where("selected = 'Y'").select("qid", F.col("file").alias("key")))


@query(f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN ' {REFUSAL_TEXT} ' ELSE text END AS t, conv_id % 2 = 0 AS must_refuse,
  CASE WHEN conv_id % 3 = 0 THEN [] WHEN conv_id % 3 = 1 THEN [text[3:20], 'zzz'] ELSE ['ZZZ'] END AS expected, CASE WHEN conv_id % 5 <> 0 THEN conv_id % 5 <> 1 END AS audit FROM conversations),
m AS (SELECT conv_id, turn, trim(t) = '{REFUSAL_TEXT}' AS refusal, (trim(t) = '{REFUSAL_TEXT}') = must_refuse AS refusal_ok,
  len(expected) = 0 OR len(list_filter(expected, lambda x: contains({folded('t')}, {folded('x')}))) > 0 AS expected_quote_hit, coalesce(audit, true) AS audit_passed FROM a)
SELECT *, refusal_ok AND expected_quote_hit AND audit_passed AS pass_all FROM m""")
def base_metrics(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 1, F.lit(f" {REFUSAL_TEXT} ")).otherwise(F.col("text")).alias("final_answer"), (F.col("conv_id") % 2 == 0).alias("must_refuse"),
        F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 3 == 1, F.array(F.substring("text", 3, 18), F.lit("zzz"))).otherwise(F.array(F.lit("ZZZ"))).alias("expected"),
        F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 5 != 1).alias("audit_passed"),
    )
    return metrics.base_metrics(rows).select("conv_id", "turn", "refusal", "refusal_ok", "expected_quote_hit", "audit_passed", "pass_all")


#: Scores 0 to 6 and halves from the labels' ids.
GRADES = "grades AS (SELECT source, quality, CAST(doc_id % 7 AS DOUBLE) + CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0 END AS score, doc_id % 3 <> 0 AS is_int FROM labels JOIN documents USING (doc_id))"


def _grades(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    score = (F.col("doc_id") % 7).cast("double") + F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.0)
    return rows.select("source", "quality", score.alias("score"), (F.col("doc_id") % 3 != 0).alias("is_int"))


@query(f"WITH {GRADES} SELECT source, avg(score) FILTER (is_int AND score BETWEEN 0 AND 5) AS mean, count(*) AS n FROM grades GROUP BY source")
def grade_mean_int(spark, d):
    return _grades(spark, d).groupBy("source").agg(metrics.grade_mean(F.col("score"), F.col("is_int")).alias("mean"), F.count("*").alias("n"))


@query(f"""WITH {GRADES}, m AS (SELECT source, avg(score) FILTER (quality = 0) AS extras_mean_relevance, count(*) FILTER (quality = 0) AS extras_count_graded,
  avg(score) FILTER (quality = 1) AS expected_quotes_mean_relevance, count(*) FILTER (quality = 1) AS expected_quotes_count_graded FROM grades GROUP BY source)
SELECT *, (coalesce(extras_mean_relevance, 0) * extras_count_graded + coalesce(expected_quotes_mean_relevance, 0) * expected_quotes_count_graded) / nullif(extras_count_graded + expected_quotes_count_graded, 0) AS answers_mean_relevance,
  extras_count_graded + expected_quotes_count_graded AS answers_count_graded FROM m""")
def grade_weighted(spark, d):
    part = lambda q: F.when(F.col("quality") == q, number(F.col("score")))
    means = _grades(spark, d).groupBy("source").agg(
        F.avg(part(0)).alias("extras_mean_relevance"), F.count(part(0)).alias("extras_count_graded"), F.avg(part(1)).alias("expected_quotes_mean_relevance"), F.count(part(1)).alias("expected_quotes_count_graded")
    )
    both = metrics.weighted_mean(*(F.col(c) for c in ("extras_mean_relevance", "extras_count_graded", "expected_quotes_mean_relevance", "expected_quotes_count_graded")))
    return means.withColumn("answers_mean_relevance", both).withColumn("answers_count_graded", F.col("extras_count_graded") + F.col("expected_quotes_count_graded"))


@query("SELECT doc_id, md5(text[1:500]) AS snippet, length(text[1:400]) AS span FROM documents")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(snippet(F.col("text"))).alias("snippet"), F.length(snippet(F.col("text"), 400)).cast("long").alias("span"))
