"""Section tables, section files, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundq.functions.numbers import METRICS, display, report_link
from groundq.functions.text import html_escape, safe_slug
from groundq.operators.retrieve import last_wins
from groundq.operators.runs import trend


def write_sections(sections: DataFrame, path: str) -> None:
    """The section table, a folder a book. Of sections with one file name the last one stays."""
    once = last_wins(sections, ["book", "filename"], "ordinal", [c for c in sections.columns if c not in ("book", "filename")])
    once.write.mode("overwrite").partitionBy("book").parquet(path)


def export_section_files(sections: DataFrame, path: str) -> None:
    """One text file a section, in a folder named after it: Spark's writer, so any file system that it reaches."""
    sections.select("filename", F.concat(F.trim("text"), F.lit("\n")).alias("text")).write.mode("overwrite").partitionBy("filename").text(path)


def run_folder(timestamp, version, mode):
    """Column: the name of a run's folder."""
    return F.concat_ws("__", timestamp, safe_slug(F.coalesce(version, F.lit("nogit"))), safe_slug(mode))


def run_path(root: str, corpus, suite, timestamp, version, mode):
    """Column: the folder of a run below its corpus and suite."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), safe_slug(corpus), safe_slug(suite), run_folder(timestamp, version, mode))


def create_store(chunks: DataFrame, path: str) -> None:
    """A new store of chunks (file_id, filename, ...); a store that is already there is an error. It is complete once the job is."""
    chunks.write.mode("errorifexists").parquet(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """More chunks for a store."""
    chunks.write.mode("append").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines with every field, null ones too."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_config(config: DataFrame, path: str) -> None:
    config.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def result_cards(results: DataFrame, selection_chars: int = 200_000, trace_chars: int = 20_000) -> DataFrame:
    """(id, html): a card a test, built where the rows are; long selections and traces are cut for display."""
    cell = lambda c, n=None: html_escape(F.substring(F.col(c).cast("string"), 1, n) if n else F.col(c).cast("string"))
    status = F.when(F.col("pass_all"), "✅").otherwise("❌")
    parts = [F.lit("<div class='card'><b>"), status, F.lit(" "), cell("id"), F.lit("</b><p>"), cell("question"), F.lit("</p><pre>"), cell("final_answer"), F.lit("</pre><pre>"), cell("selection", selection_chars), F.lit("</pre><pre>"), cell("trace", trace_chars), F.lit("</pre></div>")]
    return results.select("id", F.concat(*parts).alias("html"))


def trend_tables(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, html): for each test, or other key, a table of its runs in order of time, cells coloured by the change from the run before."""
    out = rows
    for m in metrics:
        kind = METRICS[m.removeprefix("m__")][0]
        out = trend(out, key, m).withColumn(f"_{m}", F.concat(F.lit("<td class='num "), F.col("change"), F.lit("'>"), html_escape(display(F.col(m), kind)), F.lit("</td>"))).drop("previous", "change", "shown")
    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("timestamp")), F.lit("</td><td>"), html_escape(F.col("run_dir")), F.lit("</td>"), *(F.col(f"_{m}") for m in metrics), F.lit("</tr>"))
    each = F.array_sort(F.collect_list(F.struct("timestamp", "run_dir", row.alias("row"))))
    head = "<table><tr><th>timestamp</th><th>run_dir</th>" + "".join(f"<th>{m.removeprefix('m__')}</th>" for m in metrics) + "</tr>"
    return out.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(each, lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))


def summary_block(means: DataFrame) -> DataFrame:
    """(html): the runs' means as one table, in report order, with a link to each run's own report. As many rows as there are runs."""
    names = [m for m in METRICS if f"m__{m}" in means.columns]
    cells = [F.concat(F.lit("<td class='num'>"), html_escape(display(F.col(f"m__{m}"), METRICS[m][0])), F.lit("</td>")) for m in names]
    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("timestamp")), F.lit("</td><td class='link'>"), report_link(F.col("run_dir")), F.lit("</td>"), *cells, F.lit("</tr>"))
    each = F.reverse(F.array_sort(F.collect_list(F.struct("timestamp", "run_dir", row.alias("row")))))
    head = "<table><tr><th>timestamp</th><th>run</th>" + "".join(f"<th>{m}</th>" for m in names) + "</tr>"
    return means.agg(F.concat(F.lit(head), F.array_join(F.transform(each, lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))


def write_report(blocks: DataFrame, key: str, path: str, title: str) -> None:
    """Blocks in order of the key, as one HTML document in text parts whose names are in that order; no task holds them all."""
    ends = [(0, f"<html><meta charset='utf-8'><title>{title}</title>"), (2, "</html>")]
    whole = blocks.select(F.lit(1).alias("part"), F.col(key).cast("string").alias("key"), "html")
    whole = whole.union(blocks.sparkSession.createDataFrame([(n, "", t) for n, t in ends], "part int, key string, html string"))
    whole.orderBy("part", "key").select(F.col("html").alias("value")).write.mode("overwrite").text(path)
