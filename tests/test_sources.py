import json

import pytest

from groundq.sources import readers, writers


def test_section_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.TXT").write_bytes(b"\xe9")
    (tmp_path / "c.doc").write_bytes(b"x")
    assert {r.filename: r.text for r in readers.section_texts(spark, str(tmp_path)).collect()} == {"a.txt": "é", "b.TXT": "é", "c.doc": "x"}
    assert [r.name for r in readers.indexable(spark, str(tmp_path)).collect()] == ["a.txt", "b.TXT"]
    assert [r.name for r in readers.indexable(spark, str(tmp_path), 1).collect()] == ["a.txt"]
    with pytest.raises(ValueError):
        readers.indexable(spark, str(tmp_path), -1)
    rows = spark.createDataFrame([("a.txt",), ("no.txt",)], "filename string")
    got = readers.with_section_text(rows, readers.section_texts(spark, str(tmp_path)), "d")
    assert {r.section_text for r in got.collect()} == {"é", "[ERROR reading d/no.txt]"}
    (tmp_path / "book.md").write_bytes(b"a\r\nb\rc")
    assert readers.book(spark, str(tmp_path / "book.md")).first().text == "a\nb\nc"


def test_suite(spark, tmp_path):
    tests = [{"id": "t1", "question": "q", "must_refuse": True, "expected": [{"ch": 1, "sec": 2}], "expected_quote_contains": ["a", "b"]}, {"id": "t2", "expected_quote_contains": "x"}, {"id": "t3", "expected_quote_contains": ""}]
    (tmp_path / "pool_a.json").write_text(json.dumps({"mode": "m", "tests": tests}, indent=1))
    got = {r.id: r for r in readers.suite(spark, str(tmp_path / "pool_a.json")).collect()}
    assert got["t1"].suite_id == "pool_a" and got["t1"].must_refuse and got["t1"].expected_quotes == ["a", "b"]
    assert got["t2"].expected_quotes == ["x"] and got["t3"].expected_quotes == [] and not got["t2"].must_refuse
    assert [tuple(r) for r in readers.expected_pairs(readers.suite(spark, str(tmp_path / "pool_a.json"))).collect()] == [("t1", 1, 2)]
    (tmp_path / "bad.json").write_text('{"mode": "m"}')
    with pytest.raises(Exception, match="list of tests"):
        readers.suite(spark, str(tmp_path / "bad.json")).collect()


def test_runs(spark, tmp_path):
    for name, has in (("c/s/r1", True), ("c/s/r2", False)):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "config.json").write_text(json.dumps({"timestamp": "2024", "suite_id": "s", "n_tests": 1}, indent=1))
        if has:
            (tmp_path / name / "results.jsonl").write_text('{"id":"t","metrics":{"final_recall":0.5}}\n\n{"id":"u"}\n')
    configs, results = readers.runs(spark, str(tmp_path))
    assert [(r.run_dir, r.n_tests) for r in configs.collect()] == [("c/s/r1", 1)]
    assert sorted((r.run_dir, r.id) for r in results.collect()) == [("c/s/r1", "t"), ("c/s/r1", "u")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "x.txt", "old"), ("b", 2, "x.txt", "new"), ("b", 3, "y.txt", "é")], "book string, ordinal long, filename string, text string")
    writers.write_sections(rows, str(tmp_path / "sections"))
    kept = spark.read.parquet(str(tmp_path / "sections"))
    assert {r.filename: r.text for r in kept.collect()} == {"x.txt": "new", "y.txt": "é"}
    writers.export_section_files(kept, str(tmp_path / "files"))
    assert {r.value for r in spark.read.text(str(tmp_path / "files")).collect()} >= {"new", "é"}
    writers.write_results(rows.selectExpr("book", "cast(null as string) AS n", "text"), str(tmp_path / "out"))
    assert all("n" in json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())
    cards = writers.result_cards(spark.createDataFrame([("t<", True, "q", "a&b", "s" * 9, "t" * 9)], "id string, pass_all boolean, question string, final_answer string, selection string, trace string"), 5, 5)
    assert "t&lt;" in cards.first().html and "a&amp;b" in cards.first().html and "ssssss" not in cards.first().html
    runs = spark.createDataFrame([("t", "1", "r1", 1.0), ("t", "2", "r2", 0.5)], "test_id string, timestamp string, run_dir string, m__retrieval_mean_rank double")
    blocks = writers.trend_tables(runs, "test_id", ["m__retrieval_mean_rank"])
    page = blocks.first().html
    assert "num neutral'>1,0" in page and "num good'>0,5" in page and page.index("r1") < page.index("r2")
    writers.write_report(blocks, "test_id", str(tmp_path / "report"), "Runs")
    parts = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert parts.startswith("<html>") and parts.rstrip().endswith("</html>") and parts.index("r1") < parts.index("r2")


def test_stores_folders_and_summary(spark, tmp_path):
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([("f1", "a.txt")], "file_id string, filename string")
    writers.create_store(chunks, str(tmp_path / "store"))
    writers.append_chunks(chunks, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    with pytest.raises(Exception, match="exists"):
        writers.create_store(chunks, str(tmp_path / "store"))
    (tmp_path / "files.jsonl").write_text('{"file_id":"f1","filename":"a.txt"}\n{"filename":"b"}\n')
    assert [tuple(r) for r in readers.file_metadata(spark, str(tmp_path / "files.jsonl")).collect()] == [("f1", "a.txt")]
    assert [tuple(r) for r in readers.file_ids(spark, ["x", "y"]).collect()] == [(0, "x"), (1, "y")]
    row = spark.createDataFrame([("2024-01-01_00-00-00", None, "a b", "C", "s/1")], "t string, v string, m string, c string, s string")
    assert row.select(writers.run_path("out/", F.col("c"), F.col("s"), F.col("t"), F.col("v"), F.col("m"))).first()[0] == "out/C/s_1/2024-01-01_00-00-00__nogit__a_b"
    means = spark.createDataFrame([("1", "r<1", 0.5), ("2", "r2", None)], "timestamp string, run_dir string, m__final_recall double")
    page = writers.summary_block(means).first().html
    assert "50%" in page and 'href="r&lt;1/report.html"' in page and page.index("r2") < page.index("r&lt;1")


def test_order_of_result_rows(spark, tmp_path):
    folder = tmp_path / "c" / "r1"
    folder.mkdir(parents=True)
    (folder / "config.json").write_text('{"timestamp": "2024"}')
    (folder / "results.jsonl").write_text("".join(json.dumps({"id": f"t{i}"}) + "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        _, results = readers.runs(spark, str(tmp_path))
        assert [r.id for r in results.orderBy("row_ord").collect()] == [f"t{i}" for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
