import zlib

import numpy as np
from pyspark.sql import functions as F

from groundq.llm.boosting import calibrated, fit_isotonic, fit_trees
from groundq.llm.query_toxicity import op6_toxicity
from groundq.llm.toxicity import FEATURES, features, fit, learn_lexicon, score_texts, train

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op6_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    toxic, clean = ([s for s, t in held if t == k] for k in (1, 0))
    rank = np.mean([np.mean(np.array(clean) < s) + 0.5 * np.mean(np.array(clean) == s) for s in toxic])
    assert rank >= 0.98
    assert np.mean([s >= 0.5 for s in toxic]) >= 0.85 and np.mean([s >= 0.5 for s in clean]) <= 0.01


def test_boosting_and_calibration():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = fit_trees(x[:2000], y[:2000])
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    at, value = fit_isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(value) >= 0).all() and np.allclose(calibrated(np.array([0.0, 2, 9]), at, value), [0, 1 / 3, 1])
    assert fit_trees(x, np.zeros(3000)).trees == [] and calibrated(np.array([1.0]), np.zeros(0), np.zeros(0)).tolist() == [0.0]


def test_features():
    lexicon = learn_lexicon([], np.zeros(0))
    f = dict(zip(FEATURES, features(["YOU idiot!! a*b c3 d?", "", "x"], lexicon)[0], strict=True))
    assert f["insults"] == 1 and f["aimed share"] == 1 and f["masked letters"] == 1 / 21 and f["exclamations"] == 2 / 21
    assert f["mixed words"] == 1 / 6 and f["words in capitals"] == 1 / 6 and f["capitals"] == 3 / 21
    assert (features([""], lexicon) == 0).all()


def test_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "you idiot " * 20_000, "x"), (3, "a b", "x"), (3, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, toxic int")
    model = train(df, none, id="doc_id", text="text", label="toxic")
    got = score_texts(df, model, keys=["doc_id"], text="text").collect()
    assert len(got) == 5 and {r.score for r in got} == {0.0}
    model = fit(["you idiot"] * 30 + ["a b"] * 30, np.array([1.0] * 30 + [0.0] * 30))
    got = {r.doc_id: r.score for r in score_texts(df, model, keys=["doc_id"], text="text").collect()}
    assert got[2] > 0.9 and got[3] < 0.1
    assert score_texts(df.where(F.lit(False)), model, keys=["doc_id"], text="text").count() == 0


def test_isotonic_and_a_stump_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 60).astype(float)
    y = (rng.random(60) < x / 12).astype(float)
    at, value = fit_isotonic(x, y)
    got = calibrated(np.arange(12.0), at, value)
    # the isotonic mean at a score is the largest mean that starts at or below it of the smallest that ends at or above it
    mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
    seen = sorted(set(x))
    want = [max(min(mean(a, b) for b in seen if b >= s) for a in seen if a <= s) for s in seen]
    assert np.allclose(got[np.array(seen, int)], want)
    values = rng.standard_normal((200, 3))
    truth = (values[:, 1] > 0.3).astype(float)
    tree = fit_trees(values, truth, rounds=1, depth=1, bins=1000)
    feature, border, *_ = tree.trees[0]
    p = truth.mean()

    def gain(f, cut):
        left = values[:, f] < cut
        g, h = p - truth, np.full(200, p * (1 - p))
        return sum(g[s].sum() ** 2 / (h[s].sum() + 2.0) for s in (left, ~left))

    best = max((gain(f, c), f) for f in range(3) for c in np.sort(values[:, f])[5:-5])
    assert feature[0] == best[1] == 1 and np.isclose(gain(1, tree.edges[1][border[0]]), best[0])


def test_an_id_with_several_texts_and_bounds(spark):
    rows = spark.createDataFrame([(i, "you idiot" if i % 2 else "a b") for i in range(40)] + [(1, "aa first"), (1, "zz last")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    models = [train(rows.repartition(n), labels, id="doc_id", text="text", label="toxic") for n in (1, 5)]
    assert models[0].at.tolist() == models[1].at.tolist() and models[0].value.tolist() == models[1].value.tolist()
    assert len(train(rows, labels, id="doc_id", text="text", label="toxic", rows=4).at) <= 4 and len(train(rows, labels, id="doc_id", text="text", label="toxic", text_bytes=20).at) <= 4
