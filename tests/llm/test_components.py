import random

import numpy as np

from groundq.llm.components import connected_components, roots
from groundq.llm.texts import Words, text_blocks


def test_components_against_union_find(spark):
    rng = random.Random(11)
    chain = [(i, i + 1) for i in range(1000, 1300)]
    star = [(5000, 5000 + i) for i in range(1, 400)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges = chain + star + loose + [(7, 7)] + chain[:5]
    rng.shuffle(edges)
    low = {x: x for e in edges for x in e}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = [tuple(r) for r in connected_components(df).collect()]
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(got) == sorted((x, find(x)) for x in linked)
    assert connected_components(df.limit(0)).count() == 0


def test_roots():
    assert roots(6, np.array([4, 2, 1]), np.array([2, 1, 5])).tolist() == [0, 1, 1, 3, 1, 1]


def test_text_blocks_unpack_every_row(monkeypatch):
    import pyarrow as pa

    from groundq.llm import texts

    monkeypatch.setattr(texts, "BLOCK_BYTES", 10)
    column = ["abc", None, "", "é" * 30, "x", "y" * 9, "zz"]
    found = list(text_blocks(pa.array(column)))
    assert [t for _, _, part in found for t in part] == [x or "" for x in column]
    assert [(a, b) for a, b, _ in found] == list(zip([0, *(b for _, b, _ in found)][:-1], [b for _, b, _ in found], strict=True)) and found[-1][1] == len(column)
    assert list(text_blocks(pa.array([], pa.string()))) == []
    assert len(Words([]).hashes) == 0
