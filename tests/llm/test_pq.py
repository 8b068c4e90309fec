"""Near duplicates among embeddings beside all pairs."""

import math

import numpy as np
import pytest

from inkblot.llm import pq

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain_duplicates(rows, threshold=0.98):
    able = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v) / max(map(abs, v))
            able.append((i, label, u / np.linalg.norm(u)))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, label, u) in enumerate(able):
        for j, other, w in able[:x]:
            if label == other and len(u) == len(w) and u @ w >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), vec_id), vec_id) if vec_id is not None else None
    return [(r[0], links[i], least[find(i)], r[0] is None or r[0] == least[find(i)]) for i, r in enumerate(rows)]


def clustered(n, dim=16, seed=5, spread=0.05):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 6), dim))
    of = rng.integers(0, len(base), n)
    return base[of] + spread * rng.normal(size=(n, dim)) * rng.integers(0, 3, (n, 1))


def odd_rows():
    big = [1e200, -1e200] + [0.0] * 14
    return [
        (5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None] + [0.0] * 14, 1), (5003, [float("nan")] * 16, 1), (5004, [float("inf")] + [0.0] * 15, 1),
        (5005, big, 1), (5006, [x / 1e200 for x in big], 1), (5007, [1e-300, -1e-300] + [-0.0] * 14, 1), (5008, big, None), (None, big, 1),
        (5010, [1.0, 2.0], 1), (5011, [2.0, 4.0], 1), (5012, [2.0, 4.0], 1), (5013, [], 1), (5012, [-2.0, 4.0], 1),
    ]


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("lists,block", [(1024, 2048), (20, 16)])
def test_links_and_components(spark, lists, block):
    vectors = clustered(400)
    rows = [(i, v.tolist(), int(i % 3 > 0)) for i, v in enumerate(vectors)]
    rows += [(9000 + i, rows[7][1], rows[7][2]) for i in range(40)] + [rows[3], (8000, rows[3][1], 7)] + odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cid", "2 as key", "3 as n_links").repartition(4)
    got = pq.near_duplicates(df, lists=lists, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = plain_duplicates(rows)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 2000


def test_a_margin_as_wide_as_the_reach_misses_nothing(spark):
    """Vectors without clusters, of which many links cross the borders of lists."""
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(600, 3)))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pq.near_duplicates(df, margin=0.2, lists=20, block=32).collect()
    assert sorted(map(tuple, got)) == sorted(plain_duplicates(rows))


def test_recall_with_the_default_margin(spark):
    vectors = clustered(900, dim=64, seed=8, spread=0.06)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    got = pq.near_duplicates(spark.createDataFrame(rows, SCHEMA), lists=30).collect()
    want = sum(r[1] for r in plain_duplicates(rows))
    assert want > 500 and 0.99 * want <= sum(r.n_links for r in got) <= want


def test_codes_never_hide_a_link():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    q = pq.Quantiser(points[:200], 5, parts=4, codes=16)
    home, _ = q.place(points, 0.1)
    codes, lost = q.code(points, home)
    for h in range(5):
        there = home == h
        about = q.products(points[:50], h, codes[there])
        assert (np.abs(about - points[:50] @ points[there].T) <= lost[there] + 1e-9).all()


def test_empty_and_unusable_tables(spark):
    assert pq.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, 1), (2, [0.0], 1), (None, [1.0], 1), (3, [1.0], None)]
    got = pq.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_duplicates(rows), key=key)
