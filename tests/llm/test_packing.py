import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundq.llm import tokens
from groundq.llm.packing import combinations, pack_documents, plan, solve_repeats
from groundq.llm.query_packing import digests

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "it's  two\n\n x", "é𝔸 ½ ٣ \x85　x", "<|endoftext|> <|endoftext", "x" * 70_000, " " * 3000 + "y", "ab " * 60_000, "퟿\x00\t\r\n"]
RUNS = [" " * 10**6 + "a", "\t" * 10**6 + "a", " \n" * (10**6 // 2) + "a", "a" + " " * 10**6, "'" * 10**5 + "s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return tokens.Encoder(open(PATH, encoding="utf-8").read())


def test_ids_are_those_of_the_library(spark, library, own):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [x or "" for x in ODD] + RUNS
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_ids_of_random_texts_alone_and_in_parts(library, own, monkeypatch):
    rng = random.Random(1)
    letters = "ab '’stremvdlE1٣½ \n\t\x0b\x1c\x85\xa0　!.,é𝔸中́​😀"
    for part in (tokens.PART_CHARS, 20):
        monkeypatch.setattr(tokens, "PART_CHARS", part)
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
        texts = [t + "<|endoftext|>" + t if i % 50 == 0 else t for i, t in enumerate(texts)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_remembered_pieces_can_be_forgotten(library, own, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    for text in ("one two three four", "two five four", "one"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_that_come_again_are_kept(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 64)
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    own, rng = tokens.Encoder(open(PATH, encoding="utf-8").read()), random.Random(4)
    learn, learned = own._learn, []
    monkeypatch.setattr(own, "_learn", lambda pieces: learned.extend(pieces) or learn(pieces))
    for _ in range(300):
        texts = [" ".join([*(f"common{i}" for i in range(10)), *(f"w{rng.randrange(10**6)}" for _ in range(12))])]
        assert own.encode(texts)[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
        assert own.count < 64 + 100 and len(own.names) + len(own.recent) == own.count
    assert learned.count(" common5") < 10


def test_least_squares():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 64, 3000), np.full(500, 40), np.array([63]), rng.integers(30, 40, 700)):
        counts = np.bincount(lengths, minlength=65)
        patterns = combinations(counts, 64)
        x = solve_repeats(patterns, counts)
        assert (x >= 0).all() and (not len(patterns) or (patterns.sum(axis=1) == 64).all())
        if len(patterns):
            grad = np.array([sum((np.bincount(patterns.ravel(), np.repeat(x, 3), 65) - counts)[n] for n in p if n) for p in patterns])
            assert (grad > -0.05 * counts.max() - 1).all()  # no pattern would still help much


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(5)
    some = (rng.integers(1, 64, 3000), np.full(500, 40), np.array([63]), rng.integers(30, 40, 700), np.full(100_001, 63), np.full(999, 33), np.array([], int), rng.integers(60, 64, 10))
    for lengths in some:
        counts = np.bincount(lengths, minlength=64)
        planned, at = plan(counts, 64), defaultdict(list)
        for n in np.flatnonzero(counts):
            for rank in range(counts[n]):
                begin = 0
                for a, b, sequence, offset in planned.pieces(int(n), rank):
                    assert a == begin and b > a and 0 <= sequence < planned.sequences
                    at[sequence].append((offset, b - a))
                    begin = b
                assert begin == n
        total, short = 0, []
        for sequence in range(planned.sequences):
            offset = 0
            for o, n in sorted(at[sequence]):
                assert o == offset
                offset += n
            total += offset
            short += [offset] * (offset < 64)
        assert total == lengths.sum() and all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


def test_work_does_not_grow_with_the_number_of_pieces():
    counts = np.random.default_rng(7).integers(0, 10**9, 1024)
    planned = plan(counts, 1024)
    assert planned.patterned > 0.7 * planned.sequences and sum(map(len, planned.runs.values())) < 200_000


def test_round_trip(spark, library):
    texts = ODD + RUNS[:3] + ["word " * (i * 7 % 400) for i in range(200)]
    df = spark.createDataFrame([(i if i != 3 else None, x, "clash") for i, x in enumerate(texts)] * 2, "doc_id long, text string, ids string").repartition(3)
    pieces = digests(pack_documents(df, id="doc_id", text="text", vocabulary=PATH)).collect()
    ids = {(i if i != 3 else None): library.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    seqs, seen = defaultdict(list), defaultdict(int)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and 0 < p.length <= 1024
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        seen[p.doc_id] += p.length
        seqs[p.sequence_id].append((p.offset, p.length))
    assert {k: 2 * len(v) for k, v in ids.items()} == seen
    for rows in seqs.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


@pytest.mark.parametrize("partitions", [4, 211])
def test_most_sequences_come_from_patterns(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(partitions)
    kinds = Counter(pack_documents(docs, id="doc_id", text="text", vocabulary=PATH).groupBy("sequence_id").agg({"kind": "min"}).toPandas()["min(kind)"])
    assert kinds["pattern"] > 0.75 * (kinds["pattern"] + kinds["greedy"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(df, id="doc_id", text="text", vocabulary=PATH).count() == 0
