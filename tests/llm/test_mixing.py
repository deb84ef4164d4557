import numpy as np
import pytest
from pyspark.sql import functions as F

from groundq.llm.mixing import mix_rates, mixed
from groundq.llm.query_mixing import TARGETS, op3_source_mixing

SF = "/root/testdata/sf0.1"


def test_targets_are_met(spark):
    rows = op3_source_mixing(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    p = rows[[f"p_{d}" for d in sorted(TARGETS)]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rows["rate"] >= 0).all()
    totals = (rows["rate"].to_numpy() * rows["tokens"].to_numpy())[:, None] * p
    share = totals.sum(axis=0) / rows["tokens"].sum()
    assert np.allclose(share, [TARGETS[d] for d in sorted(TARGETS)], atol=0.005)
    assert abs((rows["copies"] * rows["tokens"]).sum() / rows["tokens"].sum() - 1) < 0.03
    known = rows.set_index("doc_id").join(truth, how="inner")
    noisy = known["quality"] == 0
    assert (known.loc[noisy, "p_noisy"] > 0.5).mean() > 0.8 and (known.loc[~noisy, "p_noisy"] > 0.5).mean() < 0.03


def brute(tokens, p, targets, budget, rounds):
    """The same minimisation with a matrix of all documents."""
    rate, a = np.full(len(tokens), budget), tokens[:, None] * p
    scale = a.sum(axis=0)
    for _ in range(rounds):
        rate = np.maximum(0, rate - p @ np.where(scale > 0, (rate @ a - targets) / np.where(scale > 0, scale, 1), 0))
    return rate


def test_rates_against_brute_force(spark):
    texts = ["plain words here and there " * (i % 7 + 1) for i in range(40)] + ["%% ## $$ x& " * (i % 5 + 1) for i in range(20)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, rate string").repartition(3)
    known = spark.createDataFrame([(i, "a" if i < 40 else "b") for i in range(0, 60, 2)], "id long, domain string")
    for targets, budget in (({"a": 0.2, "b": 0.8}, 1.0), ({"a": 1.0, "b": 0.0}, 2.0), ({"a": 0.5, "b": 0.25, "c": 0.25}, 1.0)):
        rows = mix_rates(df, known, targets, id="doc_id", text="text", budget=budget, rounds=25, close=0.0).toPandas()
        p = np.stack([rows["posterior"].map(lambda s, d=d: s[f"p_{d}"]).to_numpy() for d in sorted(targets)], axis=1)
        tokens = rows["tokens"].to_numpy().astype(float)
        want = brute(tokens, p, np.array([targets[d] for d in sorted(targets)]) * budget * tokens.sum(), budget, 25)
        assert np.allclose(rows["rate"], want, atol=1e-6)
        assert rows["copies"].between(np.floor(want - 1e-9), np.ceil(want + 1e-9)).all()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    rows = [(None, None, 1), (1, "", 1), (2, "word " * 50_000, 1), (3, "a b", 1), (3, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _tokens int").where(F.lit(not empty))
    known = spark.createDataFrame([(3, "a"), (None, "b"), (2, None), (1, "zzz")], "id long, domain string")
    out = mix_rates(df, known, {"a": 1.0, "b": 1.0}, id="doc_id", text="text").collect()
    assert len(out) == (0 if empty else 5) and all(r.rate >= 0 for r in out)
    again = mixed(df, known, {"a": 1.0, "b": 1.0}, id="doc_id", text="text", budget=3.0)
    assert again.columns == df.columns
    assert again.count() == (0 if empty else sum(r.copies for r in mix_rates(df, known, {"a": 1.0, "b": 1.0}, id="doc_id", text="text", budget=3.0).collect()))
