import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import near_dup


def runs(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(docs, threshold=0.8):
    """class of each row index, by comparing all pairs."""
    sets, root = [runs(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_run = defaultdict(list)
    for i, s in enumerate(sets):
        for r in s:
            by_run[r].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for r in s:
            for j in by_run[r]:
                common[j] += 1
        for j, c in common.items():
            if j < i and c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                root[find(i)] = find(j)
    first = {}
    for i, (_, t) in enumerate(docs):
        j = first.setdefault(t or "", i)
        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least[find(i)]) for i, (d, _) in enumerate(docs)]


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = near_dup.near_classes(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(brute(docs))
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(docs)})


def test_large_near_group_and_edges(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "one two"), (203, "one two"), (204, "one three"), (205, "one two"), (205, "one two"), (206, " \t"), (207, "a " * 50000), (208, "a " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as bucket", "2 as label")
    got = near_dup.near_classes(df).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == sorted(brute(docs))
    assert near_dup.one_of_each(df).count() == len({c for _, c in brute(docs)})
    assert near_dup.near_classes(df.limit(0)).count() == 0 and near_dup.one_of_each(df.limit(0)).count() == 0


def test_unlinked_texts_of_a_large_group(spark):
    """Most texts share bands with many others and are like none; a few are like one that no leader is like."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(146)]
    docs = []
    for i in range(400):
        words = list(base)
        for j in range(r.choice([1, 3, 5, 6, 7])):
            words[r.randrange(146)] = f"x{i}.{j}"
        docs.append((i, " ".join(words)))
        if i % 20 == 0:
            docs.append((1000 + i, " ".join(words[:-1] + ["z"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dup.near_classes(df).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == sorted(brute(docs))


def test_prefix_pairs_hold_every_similar_pair(spark):
    r = random.Random(3)
    texts = []
    for g in range(30):
        base = [f"g{g}.{x}" for x in range(r.randrange(6, 200))]
        for i in range(8):
            words = list(base)
            for _ in range(r.randrange(0, 8)):
                words[r.randrange(len(words))] = f"{r.random()}"
            texts.append(" ".join(words[: len(words) - r.randrange(0, 3)]))
    rows = [(i.to_bytes(2, "big"), i, i % 3 == 0, t.encode()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "node binary, label long, open boolean, text binary")
    got = {(int.from_bytes(x.a, "big"), int.from_bytes(x.b, "big")) for x in near_dup.prefix_pairs(df, 5, 0.8).collect()}
    sets = [runs(t) for t in texts]
    true = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (i % 3 == 0 or j % 3 == 0) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert len(true) > 20 and true <= got and all(a < b for a, b in got)


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 99, "x"), (2, "a b c", 98, "y")], "doc_id long, text string, _mine long, _number string").withColumn("class_id", F.lit(5)).withColumn("NODE", F.lit("n"))
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c", 99, "x", 5, "n")]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (3, "d e f"), (None, "a b c")], "doc_id long, text string")
    assert sorted((x.class_id or 0, x.class_size) for x in near_dup.near_classes(df).collect()) == [(0, 2), (0, 2), (3, 2), (3, 2)]
    assert near_dup.one_of_each(df).count() == 2


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_weighted_jaccard(weighted):
    rng = np.random.default_rng(1)
    e = rng.integers(1, 2**63, 300).astype("u8")
    wa, wb = rng.uniform(0.2, 3.5, 300), rng.uniform(0.2, 3.5, 300)
    if not weighted:
        wa, wb = (rng.random(300) < 0.8).astype(float), (rng.random(300) < 0.8).astype(float)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = wa > 0, wb > 0
    sig = near_dup.dart_signatures(np.concatenate([e[a], e[b]]), np.concatenate([wa[a], wb[b]]), np.repeat([0, 1], [a.sum(), b.sum()]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05 and (sig != 0).all()
