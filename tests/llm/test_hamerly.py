import hashlib
import math

import duckdb
import numpy as np
import pytest

from docveil.llm import hamerly

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, key string"


def plain(rows, k=8, d=64, rounds=10):
    """Every distance in every round, in Python's whole numbers: of kept rows, (row number, cluster, distance), and the centroids."""
    kept = [(i, r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])]
    ordered = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2]))
    centroids = [r[2] for r in ordered[:k]]
    for turn in range(rounds + 1):
        of = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, _, v), (_, m) in zip(kept, of) if m == n]
                centroids[n] = [sum(x) // len(own) for x in zip(*own)] if own else centroids[n]
    return [(i, n, d) for (i, _, _), (d, n) in zip(kept, of)], centroids


def held(spark, rows, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row int, {SCHEMA}")
    return hamerly.cluster(df.repartition(3), keys=("vec_id", "row"), **more).collect()


def same(got, rows):
    want, centroids = plain(rows)
    assert sorted((r.row, r.cluster, r.distance) for r in got) == want
    inertia = sum(d for _, _, d in want)
    for r in got:
        assert r.centroid == centroids[r.cluster] and r.inertia == inertia and r.vec_id == rows[r.row][0]
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)


def test_blobs_are_clustered_by_definition(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 0.3, (6, 64))
    rows = [(i, (middle[i % 6] + rng.normal(0, 0.15, 64)).tolist(), 0, 0, "") for i in range(600)]
    log = []
    same(held(spark, rows, log=log), rows)
    assert log[0] == 600 and min(log) < 300, "bounds spare most vectors a look"


def test_edge_rows(spark):
    rng = np.random.default_rng(6)
    line = lambda *x: ([float(y) for y in x] * 64)[:64]
    rows = [(i % 9, line(i % 5), None, None, None) for i in range(40)]  # ties, repeated rows and keys, equal centroids
    rows += [(None, line(0.5, -0.5), 1, 1, "k"), (None, line(-3), 1, 1, "k"), (50, line(100000), 0, 0, ""), (51, line(-100000), 0, 0, "")]
    rows += [(60, None, 0, 0, ""), (61, [], 0, 0, ""), (62, line(1)[:63], 0, 0, ""), (63, [*line(1), 1.0], 0, 0, "")]
    rows += [(64 + j, [*line(1)[:63], bad], 0, 0, "") for j, bad in enumerate([None, float("nan"), float("inf"), float("-inf")])]
    rows += [(80, rng.normal(0, 1e-4, 64).tolist(), 0, 0, ""), (81, line(-1e-9), 0, 0, "")]
    same(held(spark, rows), rows)


def test_few_vectors_and_none(spark):
    assert held(spark, [(1, [1.0], 0, 0, "")]) == []
    rows = [(i, [float(i)] * 64, 0, 0, "") for i in range(3)]
    same(held(spark, rows), rows)
    assert hamerly.cluster(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(ValueError):
        hamerly.cluster(spark.createDataFrame([], SCHEMA), keys=("cluster",))


def test_huge_components_have_a_bound(spark):
    got = {r.row: r for r in held(spark, [(1, [3e38] * 64, 0, 0, ""), (2, [-3e38] * 64, 0, 0, ""), (3, [0.0] * 64, 0, 0, "")], k=1)}
    assert [got[i].distance for i in (0, 1, 2)] == [64 * hamerly.LARGEST**2, 64 * hamerly.LARGEST**2, 0]


def test_bounds_never_spare_a_vector_that_moves():
    rng = np.random.default_rng(7)
    for _ in range(30):
        vectors = rng.integers(-20, 20, (300, 4)).astype(np.int32)
        before = rng.integers(-20, 20, (5, 4))
        after = before + rng.integers(-3, 4, (5, 4))
        cluster, first, second = hamerly.nearest(vectors, before)
        got, upper, lower, looked = hamerly.Bounds(after, before).assigned(vectors, cluster, np.sqrt(first), np.sqrt(second))
        want, first, second = hamerly.nearest(vectors, after)
        assert (got == want).all() and looked < 300
        assert (upper >= np.sqrt(first) * (1 - 1e-15)).all() and (lower <= np.sqrt(second) * (1 + 1e-15)).all()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want, got = con.sql(hamerly.SQL), hamerly.op11(spark, "/root/testdata/sf0.01")
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
