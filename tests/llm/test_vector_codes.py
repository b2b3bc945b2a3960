import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, rounds=2, parts=16, entries=64):
    """(id, code, error, label error, digest) of each row, in Python's own integers."""
    whole = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in whole), default=0)
    width = -(-longest // parts)
    whole = [(i, v + [0] * (width * parts - len(v)), label, v) for i, v, label in whole]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cut = lambda v, p: v[width * p : width * (p + 1)]
    books = [[list(cut(r[1], p)) for r in whole[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        moved = [[list(c) for c in b] for b in books]
        for p in range(parts):
            mine = {}
            for r in whole:
                mine.setdefault(nearest(r[1], p)[1], []).append(cut(r[1], p))
            for e, points in mine.items():
                moved[p][e] = [sum(x) // len(points) for x in zip(*points, strict=True)]
        books = moved
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [(i, [nearest(v, p) for p in range(parts)], label) for i, v, label, _ in whole]
    by_label = {}
    for _, near, label in found:
        by_label[label] = by_label.get(label, 0) + min(sum(d for d, _ in near), 2**63 - 1)
    return sorted(((i, "".join(f"{e:02x}" for _, e in near), min(sum(d for d, _ in near), 2**63 - 1), min(by_label[label], 2**63 - 1), digest) for i, near, label in found), key=str)


def coded(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.codes(df).collect()), key=str)


@pytest.mark.parametrize("shard_rows,block", [(32_768, 32), (70, 7)])
def test_against_plain_rounds(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(vector_codes, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, -0.5, r.gauss(0, 1), 1e-3]) for _ in range(48)], r.choice([1, 2, 2, 2, None])) for i in range(300)]
    rows[5] = (5, None, 1)
    rows[7] = (7, [None] * 48, 1)
    rows[9] = (9, [float("nan")] * 48, 2)
    rows[11] = (11, [float("-inf")] * 48, 2)
    rows += [(1000 + i, rows[20][1], 9) for i in range(150)] + [rows[30], rows[30], (None, rows[40][1], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("shard", F.lit("clash")).withColumn("PART", F.lit(1))
    assert coded(df) == brute(rows)


def test_ragged_huge_and_few(spark):
    rows = [(0, [1.0, -2.0], 1), (1, [0.5], 1), (2, [1e18, 1.0, 1e30], None), (3, [], None), (4, [-1e18] * 17, 1), (4, [-1e18] * 17, 2)]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert coded(spark.createDataFrame([(3, [], 1), (8, [], None)], SCHEMA)) == brute([(3, [], 1), (8, [], None)])
    assert vector_codes.codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_short_lists_lose_nothing():
    """No entry outside a block's short list is nearest to any of its points, and lists are short in sorted blocks."""
    rng = np.random.default_rng(1)
    points, entries = rng.integers(-300, 300, (20_000, 4)), rng.integers(-300, 300, (64, 4))
    order, listed = vector_codes.hilbert_order(points), 0
    assert sorted(order) == list(range(len(points)))
    for at in range(0, len(points), 32):
        here = points[order[at : at + 32]]
        chosen = vector_codes.short_list(here.min(0), here.max(0), entries)
        best, distance = vector_codes.nearest(here, entries[chosen])
        want, want_distance = vector_codes.nearest(here, entries)
        assert (chosen[best] == want).all() and (distance == want_distance).all()
        listed += len(chosen)
    assert listed / math.ceil(len(points) / 32) < 25


def test_neighbours_on_the_curve():
    """Along the curve through a full grid every step goes to a neighbour."""
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    # 16 bits a component: the grid's points are scaled, and the curve passes its cells one after the other.
    walk = grid[vector_codes.hilbert_order(grid)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_sql(spark, sf_dir):
    got = queries.op12_vector_codes(spark, sf_dir).toPandas().sort_values("vec_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(queries.OP12_SQL).df().sort_values("vec_id").reset_index(drop=True)
    assert len(got) > 400 and got.equals(want[got.columns])
