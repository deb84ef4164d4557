import pytest
from pyspark.sql import functions as F

from groundq.config import REFUSAL_TEXT, Corpus, Registry
from groundq.operators import assistant, metrics, quotes, runs, segment, trace
from groundq.operators.retrieve import flag_by_file, flag_by_rank, last_wins, retrieve


def test_retrieve_against_brute_force(spark, monkeypatch):
    from groundq.operators import retrieve as module

    monkeypatch.setattr(module, "SHARD_ROWS", 7)
    monkeypatch.setattr(module, "BLOCK_ROWS", 2)
    vectors = {i: [float((i * 7) % 5), float((i * 3) % 4)] for i in range(40)}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()] + [(99, None)], "id long, v array<double>")
    asked = df.where("id % 10 = 0").select(F.col("id").alias("qid"), "v")
    got = {(r.qid, r.rank): (r.id, r.score) for r in retrieve(df, asked, id="id", vector="v", k=99).collect()}
    for q in range(0, 40, 10):
        want = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items())
        for rank, (s, i) in enumerate(want[:50], 1):
            assert got[q, rank] == (i, -s)
    assert retrieve(df.limit(0), asked, id="id", vector="v").count() == 0


def test_flags_and_last_wins(spark):
    pool = spark.createDataFrame([(1, r, f, r * 10) for r, f in enumerate(["a", "b", "a", None], 1)], "qid long, rank int, file string, x int")
    assert [r.selected for r in flag_by_rank(pool, 0).orderBy("rank").collect()] == ["Y", "N", "N", "N"]
    assert [r.selected for r in flag_by_file(pool, "file", 1).orderBy("rank").collect()] == ["Y", "N", "Y", "N"]
    assert [r.selected for r in flag_by_file(pool, "file", 4).orderBy("rank").collect()] == ["Y", "Y", "Y", "N"]
    assert {r.file: r.x for r in last_wins(pool, ["qid", "file"], "rank", ["x"]).collect()} == {"a": 30, "b": 20, None: 40}


def verified(spark, given, passages=((1, "f_ch_01_a_s02_b.txt", "The  State is\nhere."),)):
    q = spark.createDataFrame([(1, i, t, "f_ch_01_a_s02_b.txt") for i, t in enumerate(given)], "qid long, ord int, quote string, filename string")
    p = spark.createDataFrame([(1, r, f, t) for r, f, t in passages], "qid long, rank int, filename string, passage string")
    return quotes.formatted(q.select("qid").distinct(), quotes.verify(q, p)).first()


def test_quotes_are_verbatim_or_refused(spark):
    got = verified(spark, ["the state IS here.", "not there"])
    assert got.final_answer == "the state IS here.\nSource, Ch. 1 — A, §2 — B" and not got.refused and got.files == ["f_ch_01_a_s02_b.txt"]
    assert verified(spark, ["nothing of it"]).final_answer == REFUSAL_TEXT
    assert verified(spark, ["", " ", "", "", "here."]).refused  # blanks fill the four places
    two = ((1, "f_ch_01_a_s02_b.txt", "old text"), (2, "f_ch_01_a_s02_b.txt", "new text"))
    assert verified(spark, ["old text"], two).refused and not verified(spark, ["new text"], two).refused


def test_replies_of_a_model(spark):
    p = spark.createDataFrame([(1, "q?", 1, "a.txt", "x y"), (2, "q?", 1, "", "x")], "qid long, question string, rank int, filename string, passage string")
    got = quotes.extract_by_model(p, lambda q, ps: '{"quotes": [{"quote": "x", "filename": "' + ps[0]["filename"] + '"}, {"quote": 3}, 5]}').collect()
    assert [(r.qid, r.ord, r.quote, r.filename) for r in got] == [(1, 1, "x", "a.txt")]
    assert quotes.extract_by_model(p, lambda q, ps: 'Well: {"refusal": true}').count() == 0
    assert quotes.extract_by_model(p, lambda q, ps: "no json").count() == 0


def test_verbatim_search_against_brute_force(spark):
    texts = {1: "xthe old state is one great BODY of men, they say", 2: "short one here", 3: "A B", 4: None}
    items = {1: "e old state is one great body of me", 2: "one", 3: "", 4: "a b", 5: "great body of men, they  say nothing more at all"}
    a = spark.createDataFrame(list(texts.items()), "id long, text string")
    b = spark.createDataFrame(list(items.items()), "item long, want string")
    got = {tuple(r) for r in quotes.verbatim_search(a, b, id="id", text="text", item="item", item_text="want").collect()}
    fold = lambda s: " ".join((s or "").split()).lower()
    assert got == {(i, j) for i, t in texts.items() for j, w in items.items() if fold(w) and fold(w) in fold(t)}


def test_trace(spark):
    pool = spark.createDataFrame([(1, 1, "a", 0.5, 3), (1, 2, "b", 0.4, None), (1, 3, "a", 0.3, 4)], "qid long, rank int, file string, score double, chapter int")
    sources = spark.createDataFrame([(1, 9, "a", 3), (1, 3, "a", 5), (1, 7, "z", None)], "qid long, rank int, file string, chapter int")
    aligned = trace.align(sources, pool, "file")
    assert sorted((r.file, r.retrieval_rank) for r in aligned.collect()) == [("a", 1), ("a", 1), ("z", 7)]
    c = trace.coverage(pool, aligned, "file").first()
    assert (c.pool_files, c.used_files, c.used_in_pool, c.coverage_ratio, c.max_rank, c.mean_rank) == (2, 2, 1, 1.0, 7, 3.0)
    none = trace.coverage(pool.withColumn("chapter", F.lit(None).cast("int")), aligned.limit(0), "file").first()
    assert none.used_files == 0 and none.coverage_ratio is None and none.max_rank is None
    filled = trace.with_coordinates(spark.createDataFrame([(None, 4, "b_ch_07_t.txt"), (2, None, "b_ch_07_t_s01_x")], "chapter int, section int, filename string")).collect()
    assert [(r.chapter, r.section) for r in filled] == [(7, 4), (2, None)]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, f" {REFUSAL_TEXT}\n", True, [], None), (2, "A  b", False, ["x", "A b"], True), (3, "A b", False, ["a b"], False)], "id long, final_answer string, must_refuse boolean, expected array<string>, audit_passed boolean")
    got = {r.id: (r.refusal, r.refusal_ok, r.expected_quote_hit, r.audit_passed, r.pass_all) for r in metrics.base_metrics(rows).collect()}
    assert got == {1: (True, True, True, True, True), 2: (False, True, True, True, True), 3: (False, True, False, False, False)}
    tests = spark.createDataFrame([(1,), (2,)], "qid long")
    exp = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "qid long, key string")
    pool = spark.createDataFrame([(1, "a", 4, 0.5), (1, "a", 2, 0.7), (1, "c", 1, 0.9)], "qid long, key string, rank int, score double")
    cited = spark.createDataFrame([(1, "a"), (1, "c"), (1, None), (2, "a")], "qid long, key string")
    r = {r.qid: r for r in metrics.recall_metrics(tests, exp, pool, cited).collect()}
    assert (r[1].expected_total, r[1].expected_retrieved, r[1].retrieval_recall_at_20, r[1].retrieval_mean_rank, r[1].final_recall, r[1].final_unique_citations, r[1].extra_selected_count) == (2, 1, 0.5, 2.0, 0.5, 2, 1)
    assert all(v is None for k, v in r[2].asDict().items() if k != "qid")
    scores = spark.createDataFrame([(5.0, True), (2.5, False), (7.0, True), (3.0, True)], "score double, is_int boolean")
    assert scores.agg(metrics.grade_mean(F.col("score"), F.col("is_int"))).first()[0] == 4.0


def test_runs(spark):
    configs = spark.createDataFrame([("r1", "2024-01-01", None, "s", "m", 2), ("r2", "2024-01-02", None, "s", "m", 2)], "run_dir string, timestamp string, pipeline_version string, suite_id string, mode string, n_tests int")
    results = spark.createDataFrame([("r1", 1, "t", "q", "1", None), ("r1", 2, "u", "q", "bad", "x"), ("r2", 1, "t", "q", "0.5", "y")], "run_dir string, row_ord long, id string, question string, retrieval_mean_rank string, selected_pool_scores string")
    rows = runs.load_runs(configs, results)
    means = runs.in_report_order(runs.summarize_runs(rows)).collect()
    assert [(r.run_dir, r.m__retrieval_mean_rank, r.m__selected_pool_scores) for r in means] == [("r2", 0.5, "y"), ("r1", 1.0, "x")]
    moved = runs.trend(rows.where("test_id = 't'"), "test_id", "m__retrieval_mean_rank").orderBy("timestamp").collect()
    assert [(r.change, r.shown) for r in moved] == [("neutral", "1,0"), ("good", "0,5")]


def test_islands_and_headers(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["", "A", "A", "B", "A"])], "book long, at int, v string")
    got = segment.number_within(segment.number_islands(rows, "book", ["at"], "v"), ["book", "island"], ["at"]).orderBy("at").collect()
    assert [r.island for r in got] == [1, 2, 2, 3, 4] and [r.ordinal for r in got] == [1, 1, 2, 1, 1]
    text = "intro\n#One\n##T\n###S\nbody\nmore\n###S2\n\n#Two\nlast"
    got = segment.header_segments(spark.createDataFrame([(1, text)], "id long, text string"), id="id", text="text", strict=False).orderBy("chapter_number", "section_number").collect()
    assert [(r.chapter, r.chapter_title, r.section_title, r.chapter_number, r.section_number, r.content) for r in got] == [
        ("", "", "no_title", 1, 1, "intro"), ("One", "T", "S", 2, 1, "body\nmore"), ("Two", "", "no_title", 3, 1, "last"),
    ]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div class='chapter'><h2>CHAPTER I.<br>A &amp; B</h2><p>x\n y<h3>S</h3><p>z</p></div>", [("CHAPTER I. A & B", "S", "z")]),
        ("<div class='chapter'><p>a<p>b</p><div><p>c</p></div></div><p>out</p>", [(None, "No Title", "b\n\nc")]),
        ("<div class='chapter'><h3></h3><p>a</div>", [(None, "No Title", "a")]),
        ("<div class='chapter'><p>never closed</p>", []),
        ("<div class='chapter'><p>replaced</p><div class='chapter'><p>a</p></div>", [(None, "No Title", "a")]),
        ("<div class='other'><p>a</p></div>", []),
        (None, []),
    ],
)
def test_html_sections(spark, page, want):
    df = spark.createDataFrame([(1, page)], "id long, html string")
    got = segment.html_segments(df, id="id", html="html").orderBy("chapter_number", "section_number").collect()
    assert [(r.chapter_title, r.section_title, r.content) for r in got] == want


def test_assistant_payloads(spark):
    v = lambda rows, schema, c: spark.createDataFrame(rows, schema).withColumn(c, F.parse_json(c))
    files = spark.createDataFrame([("f1", "one.txt")], "file_id string, filename string")
    step = '{"tool_calls":[{"type":"other"},{"type":"file_search","file_search":{"results":[],"output":[{"file_id":"f1","score":0.5,"text":"t"},{"file":{"id":"f2"},"relevance_score":0.4,"content":{"text":"u"}}]}}]}'
    pool = assistant.pool_from_steps(v([(1, 1, step)], "qid long, step int, details string", "details"), files).orderBy("rank").collect()
    assert [(r.rank, r.file_id, r.filename, r.score, r.snippet) for r in pool] == [(1, "f1", "one.txt", 0.5, "t"), (2, "f2", None, 0.4, "u")]
    content = '[{"type":"text","text":{"value":"abc","annotations":[{"text":"sp","file_citation":{"file_id":"f1"}},{"text":"x"}]}},{"type":"image"}]'
    messages = assistant.latest_assistant_message(v([(1, 0, "user", "[]"), (1, 1, "assistant", content), (1, 2, "assistant", "[]")], "qid long, position int, role string, content string", "content"))
    cited = assistant.citations(messages, files)
    assert [(r.file_id, r.filename, r.cited_span) for r in cited.collect()] == [("f1", "one.txt", "sp")]
    s = assistant.message_summary(messages, cited)
    assert (s.first().text_blocks, s.first().text_total_len, s.first().citations) == (["abc"], 3, 1)
    assert not assistant.gate(s).first().refused and assistant.gate(s, 2).first().refused
    with pytest.raises(Exception, match="too few"):
        assistant.gate(s, 2, fail=True).collect()


def test_registry(spark):
    r = Registry(Corpus("a", "A", "store"), Corpus("b", "B"))
    assert [c.corpus_id for c in r.list()] == ["a"] and r.default().corpus_id == "a" and r.table(spark).count() == 1
    with pytest.raises(KeyError):
        r.get("b")


def test_run_pipeline_and_evaluation(spark):
    from groundq.operators.evaluation import COLUMNS, evaluate, for_corpora, results
    from groundq.operators.pipeline import NO_POOL, NO_QUOTE, asked, run_pipeline

    questions = spark.createDataFrame([(1, "Where is power?"), (2, "Nothing of it"), (3, "No pool")], "qid long, question string")
    files = {"b_ch_01_x_s02_y.txt": "Power is here. Other things.", "b_ch_01_x_s03_y.txt": "Power of men.", "b_ch_09_x_s01_y.txt": "Power is not selected."}
    pool = spark.createDataFrame([(q, r, f, 1.0 / r, t) for q in (1, 2) for r, (f, t) in enumerate(files.items(), 1)], "qid long, rank int, filename string, score double, passage string")
    sections = spark.createDataFrame(list(files.items()), "filename string, text string")
    run = run_pipeline(questions, pool, sections, k=2)
    got = {r.qid: r for r in run.answers.collect()}
    assert got[1].final_answer == "Power is here.\nSource, Ch. 1 — X, §2 — Y\n\nPower of men.\nSource, Ch. 1 — X, §3 — Y" and got[3].refused
    assert got[2].final_answer == "Power of men.\nSource, Ch. 1 — X, §3 — Y"
    view = {(r.qid, r.rank): (r.quote, r.section_text) for r in run.view.collect()}
    assert view[1, 1] == ("Power is here.", None) and view[1, 3] == (None, "Power is not selected.") and view[2, 1] == ("", None)
    summary = {r.qid: r for r in run.summary.collect()}
    assert (summary[1].pool_files, summary[1].used_files, summary[1].coverage_ratio, summary[1].used_ranks, summary[3].note) == (3, 2, 0.5, "1:1.0000,2:0.5000", NO_POOL)
    events = {q: [r.event for r in run.events.where(f"qid = {q}").orderBy("seq").collect()] for q in (1, 3)}
    assert len(events[1]) == 7 and events[3][-1] == "audit_refused"
    assert {r.qid: r.audit_reason for r in run.meta.collect()} == {1: None, 2: None, 3: NO_QUOTE}
    tests = spark.createDataFrame([(1, "Where is power?", False, [(1, 2), (7, 7)], ["power"]), (2, "Nothing of it", True, [], ["Power of"]), (3, "No pool", True, [(1, 2)], [])], "qid long, question string, must_refuse boolean, expected array<struct<chapter:int,section:int>>, expected_quotes array<string>")
    m = {r.qid: r.asDict() for r in evaluate(tests, run, sections).collect()}
    assert list(m[1])[1:] == COLUMNS and len(COLUMNS) == 25
    want = dict(refusal=False, refusal_ok=True, expected_quote_hit=False, audit_passed=True, pass_all=False, expected_total=2, expected_retrieved=1, retrieval_recall_at_20=0.5, retrieval_mean_rank=1.0, retrieval_mean_score=1.0, expected_selected=1, final_recall=0.5, final_unique_citations=2, extra_selected_count=1, extras_count_graded=1, expected_quotes_count_graded=1, quote_match_checked=2, quote_match_count=2, quote_match_rate=1.0, quote_match_all=True, quote_match_missing_source=0)
    assert {k: m[1][k] for k in want} == want
    # words: where is power / power of men, power is here: shared 1 of 5 and 2 of 4
    assert (m[1]["extras_mean_relevance"], m[1]["expected_quotes_mean_relevance"], m[1]["answers_mean_relevance"], m[1]["answers_count_graded"]) == (1.0, 2.0, 1.5, 2)
    assert m[2]["expected_total"] is None and not m[2]["refusal_ok"] and m[2]["expected_quote_hit"] and m[2]["extras_count_graded"] == 1
    assert m[3]["refusal"] and m[3]["refusal_ok"] and not m[3]["audit_passed"] and not m[3]["pass_all"] and m[3]["expected_retrieved"] == 0 and m[3]["quote_match_rate"] is None
    rows = results(tests, run, evaluate(tests, run, sections), version=None, suite_id="s", mode="short", corpus_id="c").collect()
    assert {(r.id, r.pipeline_version, r.metrics.pass_all) for r in rows} == {(1, "no_git", False), (2, "no_git", False), (3, "no_git", False)}
    assert for_corpora(tests, Registry(Corpus("a", "A", "s"), Corpus("b", "B", "s")).table(spark)).count() == 6
    with pytest.raises(Exception, match="empty"):
        asked(spark.createDataFrame([(1, " ")], "qid long, question string")).collect()


def test_pool_rows_and_grades_of_a_model(spark):
    from groundq.operators.retrieve import pool_rows

    rows = spark.createDataFrame([(1, 1, "f", "b_ch_04_t.txt", 0.5, [" a ", "", "  ", "b", None]), (1, 2, "g", None, 0.4, None)], "qid long, rank int, file_id string, filename string, score double, content array<string>")
    assert [(r.snippet, r.passage, r.chapter, r.section) for r in pool_rows(rows).orderBy("rank").collect()] == [("a b", "a b", 4, None), ("", "", None, None)]
    asked, items = spark.createDataFrame([(1, "q"), (2, "r"), (3, "s")], "qid long, question string"), spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "qid long, ref string, quote string")
    reply = lambda q, xs: '{"per_item": [{"ref": "' + xs[0]["ref"] + '", "score": 4}, {"ref": "z", "score": "bad"}, {"ref": "w", "score": 9}]}' if q == "q" else "none"
    assert sorted((r.qid, r.ref, r.score) for r in quotes.grade_by_model(asked, items, reply).fillna(-1.0).collect()) == [(1, "A", 4.0), (1, "w", 9.0), (1, "z", -1.0)]


def test_sections_of_an_html_book(spark):
    page = "<div class='chapter'><h2>CHAPTER IV.<br>Of Power &amp; Men</h2><p>one</p><h3>First</h3><p>two</p><p>three</p><h3>No Title</h3></div><div class='chapter'><h3>First</h3><p>x</p></div><div class='chapter'><h3>First</h3><p>y</p></div>"
    got = segment.sections_from_html(spark.createDataFrame([(1, page)], "id long, html string"), id="id", html="html", book="bk", number=2, book_title="state")
    assert {r.filename: r.text for r in got.collect()} == {
        "bk_book02_state_ch_04_of_power_men_s01_no_title.txt": "one\n", "bk_book02_state_ch_04_of_power_men_s02_first.txt": "two\n\nthree\n", "bk_book02_state_ch_00_no_title_s01_first.txt": "y\n",
    }


def test_logs_runs_and_messages(spark):
    meta = spark.createDataFrame([(1, 1, {"a": "x", "b": "y"}), (1, 2, {"a": "z"})], "qid long, ord int, meta map<string,string>")
    assert trace.merged_meta(meta).first().meta == {"a": "z", "b": "y"}
    log = trace.appended(spark.createDataFrame([(1, "e")], "qid long, event string"), spark.createDataFrame([(1, "f", 3)], "qid long, event string, n int"))
    assert sorted((r.event, r.n) for r in log.collect()) == [("e", None), ("f", 3)]
    events = spark.createDataFrame([("r", "2024-01-01 00:00:00", "queued"), ("r", "2024-01-01 00:00:01.5", "completed"), ("s", "2024-01-01 00:00:00", "failed")], "run string, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.run: (r.duration_ms, r.ok) for r in trace.run_duration(events, "run", "ts").collect()} == {"r": (1500, True), "s": (0, False)}
    messages = spark.createDataFrame([(1, i) for i in range(30)], "qid long, position int")
    assert assistant.newest(messages).agg(F.max("position"), F.count("*")).first()[:] == (19, 20)
    both = runs.union_runs(spark.createDataFrame([("r1", 1.0)], "run_dir string, m__a double"), spark.createDataFrame([("r2", 2.0)], "run_dir string, m__b double"))
    assert both.columns == ["run_dir", "m__a", "m__b"] and both.count() == 2


def test_verbatim_search_of_all_lengths(spark):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(n))
    texts = {i: text(rng.randint(1, 40)) for i in range(60)}
    items = {i: t for i in range(120) if (t := texts[rng.randrange(60)][(at := rng.randrange(20)) : at + rng.randint(1, 30)])}
    a, b = spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame(list(items.items()), "item long, want string")
    got = {tuple(r) for r in quotes.verbatim_search(a, b, id="id", text="text", item="item", item_text="want").collect()}
    assert got == {(i, j) for i, t in texts.items() for j, w in items.items() if w.strip() and w.strip() in t}


@pytest.mark.parametrize("held_bytes", [0, 1 << 24])
@pytest.mark.parametrize("width", [1, 3, 5])
def test_verbatim_search_of_few_and_of_many_items(spark, held_bytes, width):
    import random

    rng = random.Random(width)
    text = lambda n: " ".join("".join(rng.choice("aé\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(n))
    texts = {i: text(rng.randint(1, 30)) for i in range(50)} | {None: "a b c d e f g h", 50: "", 51: None, 52: "a b c " * 40}
    items = {i: t for i in range(90) if (t := texts[rng.randrange(50)][(at := rng.randrange(30)) : at + rng.randint(1, 60)])}
    items |= {90: "b c d e f g", 91: "h", 92: "c a", 93: " ", 94: None, 95: "c a b c a b c a b c a b", 96: "f g h i", 97: texts[1], 98: "x" * 99}
    a, b = spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame(list(items.items()), "item long, want string")
    got = quotes.verbatim_search(a, b, id="id", text="text", item="item", item_text="want", width=width, held_bytes=held_bytes)
    fold = lambda s: " ".join((s or "").split())
    want = [(i, j) for i, t in texts.items() for j, w in items.items() if fold(w) and fold(w) in fold(t)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and (None, 90) in want
    assert quotes.verbatim_search(a, b.limit(0), id="id", text="text", item="item", item_text="want", held_bytes=held_bytes).count() == 0


@pytest.mark.parametrize("held_bytes", [0, 1 << 24])
def test_verbatim_search_reads_a_long_text_once(spark, held_bytes):
    import time

    words = [f"w{i}" for i in range(30_000)]
    a = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    b = spark.createDataFrame([(1, " ".join(words[29_000:29_020])), (2, "w29999"), (3, "w1 w3"), (4, "999 w30")], "item long, want string")
    for some, want in ((b.where("item = 1"), {1}), (b.where("item > 1"), {2, 4})):
        began = time.time()
        assert {r.item for r in quotes.verbatim_search(a, some, id="id", text="text", item="item", item_text="want", held_bytes=held_bytes).collect()} == want
        assert time.time() - began < 20  # a split for each word took minutes
