import zlib

import numpy as np

from pyspark.sql import functions as F

from pricewright.llm import toxicity


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.predictions(docs.withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1)), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    # Of the six held-out toxic documents one has no telling word at all.
    assert sum(t > max(clean[1:]) or t > 0.5 for t in toxic) >= len(toxic) - 1 and sum(c < 0.5 for c in clean) >= len(clean) - 1


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x idiot y"), (1, None), (2, ""), (2, ""), (3, "idiot " * 40000), (4, "fine words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (1, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.predictions(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    # Nothing learnt: every text is as likely as not.
    rows = toxicity.predictions(docs, labels.limit(0)).collect()
    assert {r.score for r in rows} == {0.5}
    assert toxicity.predictions(docs.limit(0), labels).count() == 0


def test_misspelt(spark):
    texts = [f"some plain words {w} and more words number {i}" for i in range(60) for w in ("idiot", "table")]
    model = toxicity.SubwordModel()
    model.fit(texts, [int("idiot" in t) for t in texts])
    bad, near, good = model.scorer().scores(["plain idiot words", "plain idiott words", "plain tables words"])
    assert bad > 0.5 and near > 0.5 and good < 0.5


def test_whole_table_against_a_naive_forward_pass(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, least_z=2.0)
    assert np.abs(model.emb).sum(1).astype(bool).sum() > 20
    mask = 2**64 - 1

    def vector(word):
        raw = b"<" + word.strip(toxicity.STRIP).encode() + b">"
        ids = []
        for n in model.sizes:
            for i in range(len(raw) - n + 1):
                h = 0
                for b in raw[i : i + n]:
                    h = (h * 1_000_003 + b) & mask
                ids.append(((h * (0x9E3779B97F4A7C15 + 2 * n)) & mask) >> (64 - model.bits))
        whole = sum(b * (i + 1) ** 5 for i, b in enumerate(raw)) & mask
        ids.append(((whole * 0x9E3779B97F4A7C15) & mask) >> (64 - model.bits))
        return model.emb[ids].astype("f8").mean(0)

    for r in toxicity.score(docs.select("doc_id", "text"), model).collect():
        words = (r.text or "").lower().split()
        mean = sum(map(vector, words)) / len(words) * model.scale if words else np.zeros(model.emb.shape[1])
        z = mean @ model.out.astype("f8") + model.bias
        assert abs(r.score - 1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50)))) < 1e-3


def test_long_texts_and_repeated_ids(spark):
    docs = spark.createDataFrame([(3, "idiot " * 40000), (3, "idiot too"), (3, "idiot again"), (4, "fine words here " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, chars_per_row=1000, least_z=0.5)
    bad, good = model.scorer().scores(["an idiot", "fine words"])
    assert bad > good
