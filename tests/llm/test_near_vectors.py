import numpy as np

from groundq.llm.near_vectors import CapCode, near_duplicate_vectors


def brute(vectors, cosine):
    ids = list(vectors)
    links, root = {i: set() for i in ids}, {i: i for i in ids}
    for a in ids:
        for b in ids:
            u, v = vectors[a], vectors[b]
            if a < b and u is not None and v is not None and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= cosine:
                links[a].add(b)
                links[b].add(a)
    for _ in ids:
        for a in ids:
            root[a] = min([root[a], *(root[b] for b in links[a])])
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    vectors = {i: v for i, v in enumerate(base)}
    for i in range(40):  # near copies, a large group of exact copies in other lengths, a chain
        vectors[100 + i] = base[i % 7] + 0.15 * rng.standard_normal(64)
        vectors[200 + i] = base[0] * (1.0 if i % 2 else 2.0)
    step = base[3] / np.linalg.norm(base[3])
    for i in range(8):
        step = step + 0.04 * rng.standard_normal(64)
        step /= np.linalg.norm(step)
        vectors[300 + i] = step
    for i in range(60):  # just below and just above the threshold
        other = rng.standard_normal(64)
        other -= other @ base[40] / (base[40] @ base[40]) * base[40]
        vectors[400 + i] = base[40] / np.linalg.norm(base[40]) * (c := 0.9 + (i - 20) / 2000) + other / np.linalg.norm(other) * np.sqrt(1 - c * c)
    rows = [(int(i), [float(x) for x in v], "clash") for i, v in vectors.items()]
    odd = [(907, [1.0, 2.0], "x"), (908, [1.0, 2.0], "x"), (909, [1.0] * 65, "x"), (901, None, "x"), (902, [0.0] * 64, "x"), (903, [float("nan")] * 64, "x"), (904, [None] + [1.0] * 63, "x"), (905, [], "x"), (906, [float("inf")] * 64, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component_id string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, id="vec_id", vector="embedding", recall=0.9999).collect()}
    assert got == brute(vectors, 0.9) | {i: (0, i, True) for i, *_ in odd}


def test_recall_at_the_least_cosine():
    rng = np.random.default_rng(2)
    for n in (2_000, 50_000, 5_000_000):
        caps = CapCode(64, n)
        x = rng.standard_normal((1500, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((1500, 64))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
        sets = []
        for v in (x, y):
            row, code = caps.decode(v)
            sets.append([set(code[row == i].tolist()) for i in range(len(v))])
        recall = np.mean([bool(a & b) for a, b in zip(*sets, strict=True)])
        print(n, recall, np.mean([len(a) for a in sets[0]]))
        assert recall >= 0.95


def test_empty_null_ids_and_repeats(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, None)], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(rows, id="vec_id", vector="embedding").collect())
    assert got == [(-1, 0, None, False), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
    assert near_duplicate_vectors(rows.limit(0), id="vec_id", vector="embedding").count() == 0


def test_recall_on_large_tables():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in (54_000_000, 115_000_000):
        caps = CapCode(64, n)
        met = 0
        for lo in range(0, len(x), 100):
            a, b = (set(zip(*(part.tolist() for part in caps.decode(v[lo : lo + 100])), strict=True)) for v in (x, y))
            met += len({row for row, _ in a & b})
        assert met / len(x) >= 0.95
