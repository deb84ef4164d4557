import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundq.llm.near_texts import TOKENS, candidates_of, chosen, common_sizes, keep_one, near_duplicate_texts, runs_for
from groundq.llm.texts import Words, word_hash


def brute(texts, jaccard=0.8):
    sets = {}
    for i, t in texts.items():
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        if words:
            sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    links, root = {i: set() for i in texts}, {i: i for i in texts}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= jaccard * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    for _ in texts:
        for a in texts:
            root[a] = min([root[a], *(root[b] for b in links[a])])
    return {i: (len(links[i]), root[i], root[i] == i) for i in texts}


def corpus(n_near=60):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    new = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, base = {}, [new(rng.randint(30, 300)) for _ in range(60)]
    for b in base:
        texts[len(texts)] = line + "\n" + " ".join(b)
    for k in range(n_near):  # a few words changed, in one of a few texts; some beyond the threshold
        b = list(base[k % 5])
        for _ in range(rng.randint(0, 5)):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        texts[len(texts)] = line + "\n" + " ".join(b)
    for k in range(30):
        texts[len(texts)] = (line + "\n" + " ".join(base[9])).upper() + "!" * k
    for t in (None, "", "...", "one", "One!", "one two", "x" * 50_000, "w " * 20_000, "w " * 19_000):
        texts[len(texts)] = t
    return texts


def test_against_brute_force(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], "doc_id long, text string, kept string, n_links int").repartition(4)
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_texts(df, id="doc_id", text="text").collect()}
    assert got == brute(texts)
    classes = {r.doc_id: r.class_id for r in near_duplicate_texts(df, id="doc_id", text="text").where("doc_id IN (0, 129, 149)").collect()}
    assert classes[0] == 0 and classes[129] == classes[149] == 120  # capitals and closing marks make no other set
    kept = keep_one(df, id="doc_id", text="text")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if v[2])


def test_splits_and_chunks_give_the_same(spark, monkeypatch):
    from groundq.llm import candidates, near_texts

    for module, name, value in ((near_texts, "SMALL", 4), (near_texts, "CHUNK", 7), (candidates, "PART_BYTES", 4096)):
        monkeypatch.setattr(module, name, value)
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_texts(df, id="doc_id", text="text").collect()}
    assert got == brute(texts)


def test_repeats_null_ids_and_empty_table(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "a b c"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_links, r.component_id, r.kept) for r in near_duplicate_texts(df, id="doc_id", text="text").collect())
    assert got == [(-1, 0, None, False)] * 2 + [(5, 1, 5, True)] * 2 + [(6, 1, 5, False)] + [(7, 0, 7, True)] * 2
    assert sorted((r.doc_id or -1) for r in keep_one(df, id="doc_id", text="text").collect()) == [-1, -1, 5, 7]
    assert near_duplicate_texts(df.limit(0), id="doc_id", text="text").count() == 0


def test_recall_of_the_paths():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**32, (4000, TOKENS), dtype="u4")
    y = np.where(rng.random(x.shape) < 0.8, x, rng.integers(0, 2**32, x.shape, dtype="u4"))
    met = np.zeros(len(x), bool)
    for run in range(runs_for(0.995, 0.8)):
        paths = []
        for s in (x, y):
            row, path = chosen(s, np.full(len(s), run + 1, "u8"))
            paths.append(set(zip(row.tolist(), path.tolist(), strict=True)))
        met[[r for r, _ in paths[0] & paths[1]]] = True
    assert met.mean() >= 0.995


def test_recall_of_whole_runs(spark, monkeypatch):
    """Pairs just above the threshold, in buckets that are split down to the last level, against exact similarities."""
    from groundq.llm import near_texts

    monkeypatch.setattr(near_texts, "SMALL", 2)
    rng, texts, wanted = random.Random(3), {}, 0
    for k in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(len(words)), rng.choice([3, 4])):
            other[at] = f"v{rng.randrange(10**6)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(other)
        wanted += len(a & b) >= 0.8 * len(a | b)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_duplicate_texts(df, id="doc_id", text="text").where("n_links > 0").count()
    assert wanted > 1000 and found >= 2 * 0.99 * wanted


def test_a_chain_of_boilerplate_is_compared_along_itself(spark):
    """Each text shares two thirds of its shingles with the next one; all are connected, yet the pairs compared stay a few a text."""
    from groundq.llm.near_texts import _sketched

    n, words = 20_000, 60
    stream = [f"b{i}" for i in range(n * 11 + words)]
    df = spark.createDataFrame([(i, " ".join(stream[i * 11 : i * 11 + words])) for i in range(n)], "id long, text string").repartition(4)
    sets = _sketched(df, 5).select(F.col("id").alias("rep"), "size", "sketch")
    pairs = sum(int.from_bytes(r.mates, "big").bit_count() for r in candidates_of(sets, 0.8, 0.995).collect())
    assert 0 < pairs < 3 * n


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c", 5, 1, 2), (1, "a b c", 4, 1, 2), (2, "a b c", 3, 1, 2), (3, "x", 2, 1, 2), (None, "x", 1, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, again int, id int")
    got = keep_one(df, id="doc_id", text="text")
    assert got.columns == df.columns and sorted(tuple(r)[0] or 0 for r in got.collect()) == [0, 1, 3]
    assert [r["kept"] for r in got.where("doc_id = 1").collect()] == [4]


def test_common_sizes():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype("u8")) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert common_sizes(sets, i, j).tolist() == want
    assert common_sizes(sets, i[:5], j[:5]).tolist() == want[:5]


def test_words():
    w = Words(["Hello, wörld HELLO", "", "x", "ÉX-1"])
    assert w.first.tolist() == [0, 3, 3, 4, 6] and w.hashes[0] == w.hashes[2] == word_hash("hello")
    assert w.shingles(3)[0].tolist() == [0, 2, 3]
    with pytest.raises(AttributeError):
        Words([None])
