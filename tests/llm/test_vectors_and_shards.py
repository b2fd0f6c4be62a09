"""op1 and op3 against brute force, and their odd cases."""

import os
import struct
import zlib

import numpy as np
import pytest

from vertexloom.llm import catalog, embed_dedup, shared, sharding


def components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * s for i, s in enumerate(rng.choice([0, 0.05, 0.2, 0.35], 600))]
    return np.array(rows, np.float32)


def test_near_vectors_match_brute_force(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df, block=64, miss=1e-6).collect()}
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    part = components(len(x), np.argwhere(close))
    assert [got[i]["n_links"] for i in range(len(x))] == close.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == part
    assert all(got[i]["kept"] == (part[i] == i) for i in range(len(x)))


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<double>, rep long, content long, n long")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([(-1, 0, None, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *alone], key=lambda r: r[:2])
    # one vec_id with two vectors: each row has its own vector's links and component
    rows = [(2, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.01]), (1, [-1.0, 0.0]), (1, [1.0, 0.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df, miss=1e-6).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 2, 1), (7, 1, 2)]
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_registered_tables_miss_few_links(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum() - len(x)
    assert sum(r["n_links"] for r in embed_dedup.near_vectors(df).collect()) >= 0.995 * links


def test_components_with_hubs(spark):
    rng = np.random.default_rng(9)
    pairs = [(0, i) for i in range(3, 200)] + [(500 - i, 700) for i in range(60)] + [tuple(map(int, rng.integers(800, 1000, 2))) for _ in range(90)] + [(199, 700), (5, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = components(1000, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    for hub in (20, 100_000):
        got = {r["node"]: r["component"] for r in shared.connected_components(edges, hub=hub).collect()}
        assert got == {x: want[x] for x in touched}


def jump(key, n):
    key &= 0xFFFFFFFFFFFFFFFF
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 10, 25930, 2**31, 2**62 + 7, -1, -(2**63), 2**63 - 1, *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.select("k", sharding.jump_hash(df["k"], 24), sharding.jump_hash(df["k"], 1), sharding.jump_hash(df["k"], 25)).collect()
    assert all((r[1], r[2], r[3]) == (jump(r[0], 24), 0, jump(r[0], 25)) for r in rows)


def test_shards(spark, sf, odd):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == df.count()
        slots = {}
        for r in rows:
            assert r["shard"] == jump(r["doc_id"] or 0, 24) and r["grown_shard"] in (r["shard"], 24)
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        told = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows)
        assert told == sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert sharding.shard_documents(odd.where("false")).count() == 0


def test_native_plans_have_no_python(spark, sf):
    for name in ("op3_jump_shards", "op6_url_reputation"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert struct.calcsize("<32sI") == 36


def test_release_deletes_what_was_written(spark):
    df = shared.materialize(spark.range(3))
    path = shared._written[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    shared.release(spark)
    assert not os.path.exists(path)
