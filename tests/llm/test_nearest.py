import numpy as np
import pytest

from groundq.llm.nearest import KDTree, top_k_inner_product


def brute(vectors, k):
    out = set()
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors.items()}
    for a in q:
        if a % 50 == 0:
            score = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:k]
            out |= {(a, r, b, -s) for r, (s, b) in enumerate(score, 1)}
    return out


@pytest.mark.parametrize("size", [1.0, 1e5, 2e6])
def test_against_brute_force(spark, size):
    rng = np.random.default_rng(3)
    vectors = {i: rng.standard_normal(16) * size for i in range(900)} | {i: np.ones(16) * size for i in range(900, 940)}
    rows = [(i, [float(x) for x in v], i) for i, v in vectors.items()] * 2
    odd = [(1000, None, 0), (1050, [float("nan")] * 16, 0), (1100, [None] * 16, 0), (1150, [], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int").repartition(3)
    got = top_k_inner_product(df, id="vec_id", vector="embedding", queries="id % 50 = 0", k=5, shard_rows=60)
    assert {tuple(r) for r in got.collect()} == brute(vectors, 5)


def test_few_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = top_k_inner_product(rows, id="vec_id", vector="embedding", queries="id % 50 = 0").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512), (0, 2, 2, -256 * 256)]
    assert top_k_inner_product(rows.limit(0), id="vec_id", vector="embedding", queries="true").count() == 0


def test_several_vectors_of_an_id_lengths_and_large_scores(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 1.0]), (2, [1e300, 1e308]), (3, [-1e300, 5.0]), (4, [1e9, 0.5]), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [1e8, 1e8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k_inner_product(df, id="vec_id", vector="embedding", queries="id in (0, 2, 4)", k=3).orderBy("query_id", "rank").collect()]
    top, of = 2**63 - 1, lambda x: int(np.floor(256 * x))
    assert got == [
        (0, 1, 2, top), (0, 2, 4, 256 * of(1e9)), (0, 3, 7, 256 * of(1e8)),
        (2, 1, 0, top), (2, 2, 1, top), (2, 3, 4, top),
        (4, 1, 2, top), (4, 2, 7, min(top, of(1e9) * of(1e8) + 128 * of(1e8))), (4, 3, 1, of(1e9) * 768 + 128 * 256),
    ]


def test_boxes_are_tight_and_visits_are_few():
    points = np.random.default_rng(4).standard_normal((4000, 3))
    tree = KDTree(points, leaf=50)
    for (a, b), low, high in zip(tree.spans, tree.low, tree.high, strict=True):
        assert (tree.points[a:b].min(axis=0) == low).all() and (tree.points[a:b].max(axis=0) == high).all()
    query = np.array([1.0, 2.0, 3.0])
    bound = tree.bounds(query[None])[0]
    best = sorted(tree.search(query, bound, 5, None, np.arange(4000), -1), reverse=True)
    assert [-i for _, i in best] == np.argsort(-(points @ query))[:5].tolist()
