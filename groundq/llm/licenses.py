"""License scans: a positional index of license templates under their rarest words."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundq.llm.shared import written

#: A word: after A-Z are lower-cased, a run without ASCII controls, punctuation or capitals. On the raw text the capitals belong to it.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of templates that are not indexed; their places within a template still count.
STOP = frozenset("the of and to a an in is it or be for on with this that as are you may not any all from under at your".split())


@dataclass(frozen=True)
class Template:
    """key: the consecutive words without which the template is not accepted. whole: every word must stand in its place."""

    label: str
    text: str
    key: str
    whole: bool = False


BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software foundation"),
    Template("lgpl", "licensed under the gnu lesser general public license version", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license version", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "file except"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "hereby granted free"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
)


def indexed_words(template: Template) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(template.text.split()) if w not in STOP]


def _key_places(template: Template) -> range:
    words, key = template.text.split(), template.key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return range(at, at + len(key))


def mandatory(template: Template) -> list[tuple[int, str]]:
    """The places that must be there: all of a whole template, those of the key phrase of a notice."""
    places = range(len(template.text.split())) if template.whole else _key_places(template)
    return [(i, w) for i, w in indexed_words(template) if i in places]


def scan_licenses(
    docs: DataFrame, *, text: str, keys: list[str], base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, accept: float = 0.6, anchors: int = 2
) -> DataFrame:
    """License labels of every whole text.

    One pass keeps of each text only the words of the license vocabulary, with their places. Their document frequencies over all texts give
    the idf. Each template is posted under the `anchors` words of the highest idf among those that it cannot do without (all words of a
    whole template, the key phrase of a notice), so no match is missed. A text looks up its words that are such anchors, and only those:
    postings of one template that agree on the relative position (place in the text less place in the template) meet in one group, and
    where all anchors of the template do, it is a candidate. Then the other words of the template are looked for in their places of the
    candidates alone. A whole template needs every word; a notice needs its key phrase and the share `accept` of the template's idf. The
    score is the largest such share of any candidate (whole templates: 1 if complete), 0 without one.

    The library of notices is small, a sentence for each of fourteen; others can be given. Vocabulary, postings and idf are bounded by the
    templates, whatever the texts. Rows are told apart by a row number, so repeated or null keys do no harm: every row comes back once. A null
    text is empty: no words, no labels. Other columns are dropped, so clashing names do no harm. An empty table gives an empty result.
    Result: keys, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word, share of each accepted
    candidate, in order of place).
    """
    spark = docs.sparkSession
    templates = base + notices
    vocabulary = sorted({w for t in templates for _, w in indexed_words(t)})
    for t in templates:  # key phrases and whole templates are verified on indexed words alone
        if len(mandatory(t)) < (len(t.text.split()) if t.whole else len(_key_places(t))):
            raise ValueError(f"a stop word is part of what must be verified: {t}")
    if any(not re.fullmatch(r"[a-z0-9]+", w) for w in vocabulary):
        raise ValueError("template words are lower-case ASCII letters and digits")
    kept = {k: f"key_{i}" for i, k in enumerate(keys)}
    words = docs.select(
        *(F.col(k).alias(i) for k, i in kept.items()), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_WORD), F.lit(0)).alias("words")
    )
    # the places first: of most texts' words nothing but their number is needed
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.lower(F.get("words", i)).isin(vocabulary))
    hits = F.transform(F.when(F.size("words") > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("words", i).alias("raw"), i.alias("i")))
    plain = F.filter(hits, lambda x: F.octet_length(x["raw"]) == F.char_length(x["raw"]))  # lower() makes a letter of some signs
    found = written(
        words.select(
            F.monotonically_increasing_id().alias("rid"), *kept.values(), F.size("words").cast("long").alias("n_words"),
            F.transform(plain, lambda x: F.struct(F.lower(x["raw"]).alias("w"), x["i"].alias("i"))).alias("hits"),
        ),
        "license-words",
    )
    counts = found.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count().collect()
    n, df = found.count(), {r.w: r["count"] for r in counts}
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0 for w in vocabulary}

    rarest = [sorted(mandatory(t), key=lambda x: (df.get(x[1], 0), x[0]))[:anchors] for t in templates]
    values = lambda rows, names: spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({names})")
    # all three are as large as the templates
    lookups = F.broadcast(values([f"('{w}', {t}, {i}, {len(a)})" for t, a in enumerate(rarest) for i, w in a], "w, template, place, n_anchors"))
    postings = F.broadcast(values([f"({t}, {i}, '{w}', {idf[w]!r}D, {str(i in _key_places(x)).lower()})" for t, x in enumerate(templates) for i, w in indexed_words(x)], "template, place, w, idf, in_key"))
    needs = F.broadcast(
        values(
            [f"({t}, '{x.label}', {str(t < len(base)).lower()}, {str(x.whole).lower()}, {len(indexed_words(x))}, {len(_key_places(x))}, {sum(idf[w] for _, w in indexed_words(x))!r}D)" for t, x in enumerate(templates)],
            "template, label, is_base, whole, n_all, n_key, idf_all",
        )
    )
    rare = sorted({w for a in rarest for _, w in a})
    looked = found.select("rid", F.explode(F.filter("hits", lambda x: x["w"].isin(rare))).alias("hit")).select("rid", "hit.w", "hit.i")
    met = looked.join(lookups, "w").groupBy("rid", "template", (F.col("i") - F.col("place")).alias("start")).agg(F.count("*").alias("n"), F.max("n_anchors").alias("of"))
    met = written(met.where("n = of").select("rid", "template", "start"), "license-candidates")
    wanted = met.join(postings, "template").withColumn("i", F.col("start") + F.col("place"))
    theirs = found.join(met.select("rid").distinct(), "rid", "left_semi").select("rid", F.inline("hits"))
    candidates = (
        wanted.join(theirs, ["rid", "i", "w"])
        .groupBy("rid", "template", "start")
        .agg(F.count("*").alias("n"), F.sum("idf").alias("weight"), F.count_if("in_key").alias("in_key"))
        .join(needs, "template")
        .withColumn("share", F.when(~F.col("whole") | (F.col("n") == F.col("n_all")), F.least(F.lit(1.0), F.col("weight") / F.col("idf_all"))))
        .withColumn("accepted", F.when(F.col("whole"), F.col("n") == F.col("n_all")).otherwise((F.col("in_key") == F.col("n_key")) & (F.col("share") >= accept)))
    )
    base_hit = F.col("accepted") & F.col("is_base")
    spans = F.array_sort(F.collect_list(F.when(F.col("accepted"), F.struct("start", "label", "share"))))
    per_row = candidates.groupBy("rid").agg(
        F.count_if(base_hit).alias("n_base"),
        F.min(F.when(base_hit, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base_hit, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base_hit, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("accepted"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        spans.alias("spans"),
    )
    return found.select("rid", *kept.values(), "n_words").join(per_row, "rid", "left").select(
        *(F.col(i).alias(k) for k, i in kept.items()), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
