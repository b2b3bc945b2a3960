import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricewright.llm import mixing


def fair_targets(sizes, share=1.5, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, todo, out = share * sum(sizes.values()), set(names), {}
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if 2 * sizes[s] <= weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in todo}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        todo -= full
    return out


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, got = fair_targets(dict(sizes)), defaultdict(int)
    assert len(rows) == len(docs)
    by_id = {i: s for i, _, s in docs}
    for r in rows:
        assert r.source_size == sizes[by_id[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[by_id[r.doc_id]])
        got[by_id[r.doc_id]] += r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)


def test_taken_small(spark):
    docs = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 9000, None), (5, "e f", "Ü"), (6, "\x0b\x0c", "Ü"), (7, "g h i", "only"), (8, " ".join("w%d" % i for i in range(500)), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    check(mixing.taken(df).collect(), docs)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", "x")] * 3, "doc_id long, text string, source string")
    rows = mixing.taken(df).collect()
    assert len(rows) == 3 and abs(sum(r.taken for r in rows) - 13.5) <= 1
    assert mixing.mixed_documents(df).count() >= 3
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_whole_table_and_schedule(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    check(mixing.taken(df).collect(), docs)
    _, pieces = mixing.mix(df, block=64)
    slots = sorted({(r.slot, r.source_id) for r in pieces.collect()})
    counts, share = defaultdict(int), defaultdict(int)
    for _, s in slots:
        share[s] += 1
    for i, (_, s) in enumerate(slots):
        counts[s] += 1
        assert abs(counts[s] - share[s] * (i + 1) / len(slots)) < 12
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    texts = dict((d, t) for d, t, _ in docs)
    for r in mixed.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)


def test_columns_with_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["n_words", "first_word", "bucket", "at", "epoch", "source_id", "_id", "_copy", "_row", "size", "slot", "rank"]
    clashing = docs.select("*", *(docs.doc_id.alias(n) for n in names))
    got = mixing.mixed_documents(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert all(r[n] == r.doc_id for r in rows for n in names)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect())
