import math
import re

from groundq.llm.licenses import BASE, NOTICES, STOP, scan_licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEXTS = [
    None, "", "nothing here at all", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "MIT mit license MIT-License",
    "This work is licensed under the GNU General Public License, version 3. Licensed under the Apache License, Version 2.0.",
    "gnu general public gnu general public license license", "mitlicense  mit\n\nlicense É mit license", "cc cc by by cc\x00by ccby",
    "mıt license K mit licenſe", "word " * 30000 + "apache license", "mit " * 20000 + "license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force_and_labels(spark):
    rows = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string, n_words int")
    got = {r.doc_id: r for r in scan_licenses(rows, text="text", keys=["doc_id"]).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[4].labels == "cc-by,cc-by-nc" and got[3].labels == "mit" and got[13].labels == "mit" and got[14].labels == "bsd"
    assert got[6].labels == "apache,apache-2.0,gpl,gpl-3.0" and got[2].labels == "" and got[2].score == 0


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "mit license")] * 3 + [(1, None)], "doc_id long, text string")
    out = scan_licenses(rows, text="text", keys=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in out) == [(0, 1)] * 3 + [(1, 0)]
    assert scan_licenses(rows.limit(0), text="text", keys=["doc_id"]).count() == 0


def judged(texts, accept=0.6):
    """Labels and scores by trying every template at every place."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in s for s in split) + 1)) + 1
    out = []
    for words in split:
        labels, score = set(), 0.0
        for t in BASE + NOTICES:
            own, key = t.text.split(), t.key.split()
            at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
            weights = [0.0 if w in STOP else idf(w) for w in own]
            for start in range(-len(own), len(words)):
                same = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(own)]
                must = same if t.whole else same[at : at + len(key)]
                share = sum(x for x, s in zip(weights, same, strict=True) if s) / sum(weights)
                if all(must):
                    score = max(score, share)
                    if share >= accept:
                        labels.add(t.label)
        out.append((",".join(sorted(labels)), score))
    return out


def test_labels_and_score_against_every_place(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 10_000] + [t.text + " and more" for t in NOTICES] + ["mozilla public license v 2 0", "licensed under cc by nc", "x subject to the terms of the mozilla public license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(rows, text="text", keys=["doc_id"], anchors=9).collect()}
    for i, (labels, score) in enumerate(judged(texts)):
        assert got[i][0] == labels and math.isclose(got[i][1], score, abs_tol=1e-9), texts[i]
