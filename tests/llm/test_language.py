import zlib

import numpy as np
from pyspark.sql import functions as F

from groundq.llm.language import BITS, _rows, fit, fit_temperature, grams, identify, quotas, train
from groundq.llm.query_language import op4_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert np.mean([r.score for r in held]) - np.mean([r.lang_pred == truth[r.doc_id] for r in held]) < 0.03


def test_regression_on_its_own():
    texts = ["the thing that they saw", "der und die das nicht"] * 40
    model = fit(texts, ["en", "de"] * 40, np.ones(1 << BITS))
    logits, has = model.scores(["that thing", "nicht und", "", "123 --"])
    assert [model.classes[i] for i in logits[:2].argmax(axis=1)] == ["en", "de"] and has.tolist() == [True, True, False, False]
    assert 0 < (model.weights != 0).any(axis=1).sum() < 500 and 1e-3 <= model.temperature <= 20
    assert grams(["¿½ ² ·", "𝔸", "\U0001f600", "ß", "\udcff"])[1].tolist() == [False, True, False, True, False]
    for text, sizes in (("", [0, 0, 0]), ("a-- b", [3, 2, 1]), ("a", [1, 0, 0])):
        assert [int(b - a) for _, ((a, b),) in grams([text])[0]] == sizes
    alone, together = grams(["das x"])[0], grams(["the", "das x", ""])[0]
    assert all((f[slice(*e[0])] == g[slice(*d[1])]).all() for (f, e), (g, d) in zip(alone, together, strict=True))


def test_the_smallest_hashes_of_each_language_are_taken(spark, monkeypatch):
    from groundq.llm import language

    rows = spark.range(3000).selectExpr("id", "concat('text ', id) AS text", "CASE WHEN id % 300 = 0 THEN 'rare' WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS label")
    taken = []
    monkeypatch.setattr(language, "fit", lambda texts, labels, idf: taken.extend(zip(texts, labels, strict=True)))
    train(rows, rows, id="id", text="text", label="label", rows=200)
    quota = quotas({"a": 2000, "b": 990, "rare": 10}, 200)
    expected = []
    for label, n in quota.items():
        expected += [(r.text, label) for r in rows.where(F.col("label") == label).orderBy(F.xxhash64("id")).limit(n).collect()]
    assert sorted(taken) == sorted(expected)


def test_odd_rows(spark):
    rows = [(None, None, "en", "x"), (1, "", "en", "x"), (2, "12 !", None, "x"), (3, "the word " * 30_000, "en", "x"), (3, "the word", "en", "x"), (4, "das wort", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    more = df.union(spark.createDataFrame([(i, "das wort nicht" if i % 2 else "the word", "de" if i % 2 else "en", "") for i in range(10, 40)], df.schema))
    model = train(more, more, id="doc_id", text="text", label="lang")
    got = sorted(((r.doc_id or 0), r.lang_pred) for r in identify(df, model, keys=["doc_id"], text="text").collect())
    assert got == [(0, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (4, "de")]
    none = df.where(F.lit(False))
    assert train(none, none, id="doc_id", text="text", label="lang") is None
    assert {r.lang_pred for r in identify(df, None, keys=["doc_id"], text="text").collect()} == {"und"}
    assert identify(none, model, keys=["doc_id"], text="text").count() == 0


def test_leader_against_a_plain_one():
    """The same updates, one coordinate after the other, with the penalties written out."""
    texts, labels = ["the thing that", "der und die", "la cosa que", "that das que"] * 6, ["en", "de", "es", "de"] * 6
    idf = np.linspace(1, 2, 1 << BITS)
    l1, l2, alpha, beta = 0.02, 1e-3, 1.0, 1.0
    model = fit(texts, labels, idf, l1=l1, epochs=2)
    classes, z, n, zb, nb = sorted(set(labels)), {}, {}, [0.0] * 3, [0.0] * 3
    leader = lambda z, n: 0.0 if abs(z) <= l1 else -(z - np.sign(z) * l1) / ((beta + n**0.5) / alpha + l2)
    order, rows = np.random.default_rng(3).permutation(len(texts)), _rows(texts, idf)
    for _ in range(2):
        for i in order:
            at, v = rows[i]
            w = {(f, c): leader(z.get((f, c), 0.0), n.get((f, c), 0.0)) for f in at for c in range(3)}
            wb = [leader(zb[c], nb[c]) for c in range(3)]
            s = [sum(x * w[f, c] for f, x in zip(at, v, strict=True)) + wb[c] for c in range(3)]
            p = np.exp(s) / np.exp(s).sum()
            for c in range(3):
                g = p[c] - (classes[c] == labels[i])
                for f, x in zip(at, v, strict=True):
                    old = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g * x - ((old + (g * x) ** 2) ** 0.5 - old**0.5) / alpha * w[f, c]
                    n[f, c] = old + (g * x) ** 2
                old = nb[c]
                zb[c] += g - ((old + g * g) ** 0.5 - old**0.5) / alpha * wb[c]
                nb[c] = old + g * g
    want = np.zeros((1 << BITS, 3))
    for (f, c), value in z.items():
        want[f, c] = leader(value, n[f, c])
    assert np.allclose(model.weights, want) and (want == 0).sum() > (1 << BITS) and np.allclose(model.bias, [leader(a, b) for a, b in zip(zb, nb, strict=True)])


def test_temperature_and_quotas():
    rng = np.random.default_rng(6)
    logits = rng.standard_normal((4000, 3)) * 0.01
    p = np.exp(logits / 0.004)
    truth = (rng.random(4000)[:, None] > np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)).sum(axis=1)
    assert 0.0035 < fit_temperature(logits, truth) < 0.0045
    assert 0 < fit_temperature(np.eye(3) * 5, np.arange(3)) < np.inf
    assert quotas({"a": 100, "b": 3, "c": 50}, 60) == {"b": 3, "c": 28, "a": 29} and quotas({"a": 5, "b": 1, "c": 2}, 2) == {"c": 1, "a": 1} and quotas({}, 5) == {}


def test_weights_are_sparse(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, docs, id="doc_id", text="text", label="lang")
    seen = (model.idf < model.idf.max()).sum()
    print("features with a weight:", (model.weights != 0).any(axis=1).sum(), "of", seen, "temperature", model.temperature)
    assert (model.weights != 0).any(axis=1).sum() < 0.5 * seen


def test_rare_languages_are_learned(spark):
    rows = [(i, "the word here", "en") for i in range(300)] + [(1000 + i, "ord och ting", "sv") for i in range(3)] + [(5, "zzz", "sv")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert train(df, df, id="doc_id", text="text", label="lang", rows=20).classes == ["en", "sv"]
    assert train(df, df, id="doc_id", text="text", label="lang", text_bytes=1) is not None
