"""Quotations: extraction, verification against passages, formatting, refusal, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.config import QUOTES_MOST, REFUSAL_TEXT
from groundq.functions.refs import readable_ref
from groundq.functions.text import for_match, json_object, strip
from groundq.operators.retrieve import last_wins

#: Bytes of items that a search broadcasts, at most.
HELD_BYTES = 1 << 24


def sentences(text: Column) -> Column:
    """Sentences of a passage, each verbatim."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?s)^\s*(.*?[.!?](?=\s)|.*)", 1))


def usable(passages: DataFrame) -> DataFrame:
    """Passages that can be quoted: with a file name and with text."""
    return passages.where((F.length("filename") > 0) & (strip(F.col("passage")) != ""))


def verify(quotes: DataFrame, passages: DataFrame, most: int = QUOTES_MOST) -> DataFrame:
    """The first `most` quotes (qid, ord, quote, filename) that stand verbatim in their file's passage (qid, rank, filename, passage).

    Of several passages of a file the last one counts. Blank quotes stand in every passage: they take a place here and go in `formatted`.
    Each passage is normalised once, before the join.
    """
    last = last_wins(usable(passages), ["qid", "filename"], "rank", ["passage"]).withColumn("_norm", for_match(F.col("passage"))).drop("passage")
    held = quotes.where(F.col("quote").isNotNull()).join(last, ["qid", "filename"]).where(F.col("_norm").contains(for_match(F.col("quote"))))
    place = F.row_number().over(W.partitionBy("qid").orderBy("ord"))
    return held.withColumn("_n", place).where(F.col("_n") <= most).select("qid", "ord", strip(F.col("quote")).alias("quote"), "filename")


def formatted(questions: DataFrame, verified: DataFrame, label: str = "Source") -> DataFrame:
    """(qid, final_answer, refused, files) for every question: "quote\\nreference" blocks in order, or the refusal."""
    shown = verified.where((strip(F.col("quote")) != "") & (strip(F.col("filename")) != ""))
    block = F.concat(F.col("quote"), F.lit("\n"), readable_ref(F.col("filename"), label))
    each = F.array_sort(F.collect_list(F.struct("ord", block.alias("block"))))
    answers = shown.groupBy("qid").agg(F.array_join(F.transform(each, lambda x: x["block"]), "\n\n").alias("text"), F.sort_array(F.collect_set("filename")).alias("files"))
    return questions.select("qid").join(answers, "qid", "left").select(
        "qid", F.coalesce("text", F.lit(REFUSAL_TEXT)).alias("final_answer"), F.col("text").isNull().alias("refused"), F.coalesce("files", F.array().cast("array<string>")).alias("files")
    )


def is_refusal(answer: Column) -> Column:
    return strip(answer) == F.lit(REFUSAL_TEXT)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(for_match(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def extract_by_overlap(passages: DataFrame, most: int = QUOTES_MOST) -> DataFrame:
    """A deterministic extractor: of each question's passages (qid, question, rank, filename, passage) the sentences that share most words
    with it, at least one; ties to the better rank, then the earlier sentence."""
    each = usable(passages).select("qid", "rank", "filename", _words(F.col("question")).alias("asked"), F.posexplode(sentences(F.col("passage"))).alias("place", "quote"))
    each = each.withColumn("overlap", F.size(F.array_intersect("asked", _words(F.col("quote"))))).where("overlap > 0")
    ord_ = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("overlap"), "rank", "place"))
    return each.withColumn("ord", ord_).where(F.col("ord") <= most).select("qid", "ord", "quote", "filename", "overlap")


def extract_by_model(passages: DataFrame, complete: Callable[[str, list[dict]], str]) -> DataFrame:
    """Quotes that a model chooses. complete(question, [{filename, passage}]) returns its reply: {"refusal": true} or {"quotes": [...]}.

    A reply that is no such object gives no quotes, so the question is refused later. Replies are parsed by Spark.
    """
    asked = usable(passages).groupBy("qid").agg(F.first("question").alias("question"), F.to_json(F.array_sort(F.collect_list(F.struct("rank", "filename", "passage")))).alias("passages"))

    def reply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for f in frames:
            texts = [complete(q, [{k: p[k] for k in ("filename", "passage")} for p in json.loads(x)]) for q, x in zip(f["question"], f["passages"], strict=True)]
            yield pd.DataFrame({"qid": f["qid"], "reply": texts})

    return parse_replies(asked.mapInPandas(reply, f"qid {dict(passages.dtypes)['qid']}, reply string"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(qid, ord, quote, filename) of replies (qid, reply)."""
    found = replies.withColumn("v", json_object(F.col("reply"))).where(F.col("v").isNotNull() & ~F.coalesce(F.try_variant_get("v", "$.refusal", "boolean"), F.lit(False)))
    quotes = found.select("qid", F.posexplode(F.try_variant_get("v", "$.quotes", "array<variant>")).alias("ord", "q"))
    out = quotes.select("qid", F.col("ord") + 1, F.try_variant_get("q", "$.quote", "string").alias("quote"), F.try_variant_get("q", "$.filename", "string").alias("filename"))
    return out.toDF("qid", "ord", "quote", "filename").where(F.col("quote").isNotNull() & F.col("filename").isNotNull())


def verbatim_search(texts: DataFrame, items: DataFrame, *, id: str, text: str, item: str, item_text: str, width: int = 5, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, item): items whose normalised text stands somewhere in a normalised text.

    The words of an item but for its first and last one, which the text may continue, are whole words of the text. Up to `width` of them in a row are the
    key of an equi-join with all runs of so many words of the texts. Items of one or two words have no such words: their first `width` characters are
    the key, and meet the texts' runs of as many characters. A text is split once and its runs are read off the split by their place, so that the work grows
    with its length and not with the square of it. Items of up to `held_bytes` are broadcast, and each place that meets a key is compared there, over the item's
    length. Of more items only keys travel: a text joins once for all items that it met, and containment decides. An id that repeats stands for all its texts.
    """
    wanted = items.select(F.col(item).alias("_item"), for_match(F.col(item_text)).alias("_want")).where("_want <> ''").withColumn("_w", F.split("_want", " "))
    inner = F.least(F.size("_w") - 2, F.lit(width))
    wanted = wanted.withColumns({
        "_n": F.when(inner > 0, inner).otherwise(-F.least(F.char_length("_want"), F.lit(width))),
        "_parts": F.when(inner > 0, F.size("_w")).otherwise(F.char_length("_want")),
        "_w": F.when(inner > 0, F.slice("_w", 2, width)).otherwise(F.split("_want", "")),
    })
    run = (F.when(F.abs("_n") > k, F.get("_w", F.lit(k))) for k in range(width))  # a hash passes over nulls
    keyed = wanted.select("_item", "_want", "_parts", F.xxhash64("_n", *run).alias("_key"))
    asked = wanted.agg(F.collect_set("_n").alias("sizes"), F.coalesce(F.sum(F.octet_length("_want") + 64), F.lit(0)).alias("bytes")).first()
    broadcast = asked.bytes <= held_bytes
    held = texts.select(F.col(id).alias("_id"), for_match(F.col(text)).alias("_text"))

    def met(sizes: list[int], by: str, edge: int) -> DataFrame:
        """Runs of so many parts of a text with `edge` parts on either side: (_id, _item) of the items that stand there, or each (_id, _key) of a text."""
        places = F.when(F.size("_w") >= min(sizes) + 2 * edge, F.sequence(F.lit(edge), F.size("_w") - min(sizes) - edge))
        keys = lambda at: F.array(*(F.xxhash64(F.lit(n if edge else -n), *(F.get("_w", at + k) for k in range(n))) for n in sizes))
        split = held.select("_id", F.split("_text", by).alias("_w"))
        if not broadcast:
            return split.select("_id", F.explode(F.array_distinct(F.flatten(F.transform(places, keys)))).alias("_key"))
        runs = split.select("_id", "_w", F.explode(places).alias("_at")).select("_id", "_w", "_at", F.explode(keys(F.col("_at"))).alias("_key"))
        there = F.array_join(F.slice("_w", F.col("_at") + (1 - edge), F.col("_parts")), by)
        return runs.join(F.broadcast(keyed), "_key").where(there.contains(F.col("_want"))).select("_id", "_item")

    words, characters = (sorted(sign * n for n in asked.sizes if sign * n > 0) for sign in (1, -1))
    kinds = [(sizes, by, edge) for sizes, by, edge in ((words, " ", 1), (characters, "", 0)) if sizes]
    found = reduce(DataFrame.union, (met(*kind) for kind in kinds or [([1], " ", 1)]))
    if not broadcast:
        pairs = found.join(keyed, "_key").select(F.col("_id").alias("_met"), "_item", "_want").distinct()
        found = held.join(pairs, F.col("_id").eqNullSafe(F.col("_met"))).where(F.col("_text").contains(F.col("_want")))
    return found.select(F.col("_id").alias(id), F.col("_item").alias(item)).distinct()


def grade_by_model(questions: DataFrame, items: DataFrame, complete: Callable[[str, list[dict]], str]) -> DataFrame:
    """Grades that a model gives: (qid, ref, score) of its replies {"per_item": [{"ref", "score"}]}. complete(question, [{ref, quote}]) returns the reply.

    A question without quotes is not asked. A reply that is no such object gives no grades; scores that are no numbers are null.
    """
    each = items.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ref", "quote")))).alias("items")).join(questions, "qid")

    def reply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for f in frames:
            yield pd.DataFrame({"qid": f["qid"], "reply": [complete(q, json.loads(x)) for q, x in zip(f["question"], f["items"], strict=True)]})

    replies = each.select("qid", "question", "items").mapInPandas(reply, f"qid {dict(items.dtypes)['qid']}, reply string").withColumn("v", json_object(F.col("reply")))
    rows = replies.where("v IS NOT NULL").select("qid", F.explode(F.try_variant_get("v", "$.per_item", "array<variant>")).alias("g"))
    return rows.select("qid", F.try_variant_get("g", "$.ref", "string").alias("ref"), F.try_variant_get("g", "$.score", "double").alias("score"))


def grade_by_overlap(questions: DataFrame, quotes: DataFrame) -> DataFrame:
    """A deterministic grader: (qid, ref, score), five times the Jaccard similarity of the words, rounded down. No quotes, no rows."""
    both = quotes.join(questions, "qid").withColumns({"a": _words(F.col("question")), "b": _words(F.col("quote"))})
    score = F.floor(5.0 * F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1)))
    return both.select("qid", "ref", score.cast("int").alias("score"))
