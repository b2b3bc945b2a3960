import math
import random

import duckdb
import numpy as np
import pytest

from pricewright.llm import queries, topk


def brute(rows, k=5, every=50):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in whole.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block", [(8192, 1024), (90, 7)])
def test_against_all_pairs(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, 1e-3, r.gauss(0, 1)]) for _ in range(6)]) for i in range(600)]
    rows[3] = (3, None)
    rows[50] = (50, [None] * 6)
    rows[100] = (100, [float("nan")] * 6)
    rows[7] = (7, [float("inf")] * 6)
    rows[200] = (200, [1e12] * 6)
    rows += [(1000 + i, rows[150][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = df.select("vec_id", topk.integer_vector(df.embedding).alias("vector"))
    got = topk.top_k(whole, whole.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "vector"), shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.integer_top_k(df).collect())) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]
    assert topk.integer_top_k(df.limit(0)).count() == 0


def test_ragged_huge_and_repeated(spark):
    top = 2**63 - 1
    rows = [(0, [1e18]), (50, [1e18]), (51, [-1e18]), (100, [1.0, 2.0]), (101, [1.0, 1.0]), (150, [5.0, 5.0, 5.0]), (200, []), (201, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", topk.F.lit("x")).withColumn("length", topk.F.lit(1))
    got = sorted(map(tuple, topk.integer_top_k(df).collect()))
    assert got == [(0, 1, 50, top), (0, 2, 51, -(2**63)), (50, 1, 0, top), (50, 2, 51, -(2**63)), (100, 1, 101, 256 * 256 * 3), (200, 1, 201, 0)]
    vectors = spark.createDataFrame([(1, [3]), (1, [4]), (2, [5])], "vec_id long, vector array<long>")
    asked = spark.createDataFrame([(9, [2]), (9, [1]), (9, [2])], "query_id long, vector array<long>")
    assert sorted(map(tuple, topk.top_k(vectors, asked).collect())) == [(9, 1, 2, 5), (9, 2, 1, 4), (9, 3, 1, 3)]


def test_bounds_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 200, (20, 8))
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 3, (4000, 8))).astype("i8")
    tree = topk.BallTree(np.arange(4000), vectors)
    _, opened = tree.search(np.arange(20), vectors[:20], [None] * 20, 5)
    assert opened < 20 * len(tree.spans) / 4


def test_sql(spark, sf_dir):
    got = queries.op8_exact_top_k(spark, sf_dir).toPandas().sort_values(["query_id", "rank"])
    want = duckdb.connect().execute(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'").execute(queries.OP8_SQL).df().sort_values(["query_id", "rank"])
    assert (got[["query_id", "rank", "vec_id", "score"]].to_numpy() == want[["query_id", "rank", "vec_id", "score"]].to_numpy()).all()
