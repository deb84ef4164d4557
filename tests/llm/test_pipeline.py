import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_texts import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def after(spark, tmp_path_factory):
    """Rows after each stage, by its name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_row", F.lit("clash")), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row"]
    return out


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    larger = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{larger}/documents.parquet").collect()
    stays = ids(corpus_pipeline.toxicity(spark, spark.read.parquet(f"{larger}/documents.parquet"), larger).collect())
    toxic = {r.doc_id for r in spark.read.parquet(f"{larger}/labels.parquet").where("toxic = 1").collect()}
    insulting = {r.doc_id for r in docs if any(f" {w} " in r.text for w in ("idiot", "moron", "scum", "worthless"))}
    gone = {r.doc_id for r in docs} - set(stays)
    assert len(gone & insulting) >= 0.85 * len(insulting) and len(gone - insulting - toxic) <= 0.01 * len(docs)


def test_languages(after):
    gone = ids(after["toxicity"]) - ids(after["language"])
    text = {r.doc_id: r.text for r in after["documents"]}
    assert len(gone) <= 0.02 * len(text) and all(i in gone for i in ids(after["toxicity"]) if not any(c.isalpha() for c in text[i]))


def test_one_of_each_group_stays(after):
    before = {r.doc_id: r.text for r in after["language"]}
    assert set(ids(after["near_duplicates"])) == {i for i, v in brute(before).items() if v[2]}


def test_mixing_keeps_rows_whole(after):
    before = {r.doc_id: r for r in after["near_duplicates"]}
    assert all(before[r.doc_id] == r for r in after["mixing"])
    assert len(set(ids(after["mixing"]))) >= 0.9 * len(before)


def test_packing_holds_every_token(after):
    copies, tokens, sequences = ids(after["mixing"]), defaultdict(int), defaultdict(list)
    for r in after["packing"]:
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    whole = {r.doc_id: r.doc_tokens for r in after["packing"]}
    assert set(tokens) == set(copies) and all(tokens[i] == copies[i] * whole[i] for i in copies)
    for rows in sequences.values():
        assert sum(n for _, n in rows) <= 1024 and sorted(rows)[0][0] == 0
    assert all(zlib.crc32(b"") <= r.ids_crc32 < 2**32 for r in after["packing"])


def test_run_and_empty_table(spark, after, tmp_path):
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sum(r.length for r in after["packing"])
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "a the of and " * 9, None, None, None), (3, "a the of and " * 9, None, None, None), (4, "12", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= {3}
