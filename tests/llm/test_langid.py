import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from pricewright.llm import langid


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, "plain text", "en"), (2, None, "en"), (3, "12 %$", None), (4, "", "de"), (5, "é" * 100000, "fr"), (5, "é" * 100000, "fr"), (None, "ok", "en")], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(3))
    rows = langid.predictions(docs).collect()
    assert len(rows) == 7 and {r.doc_id: r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == dict.fromkeys((2, 3, 4), "und")
    assert all(r.lang_pred in ("en", "fr", "und") for r in rows)
    unlearnt = langid.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearnt} == {("und", 0.0)}
    assert langid.predictions(docs.limit(0)).count() == 0


def test_rare_language(spark):
    """A language in 1 of 300 documents is learnt from its own rows, not from its share in the sample."""
    rng = random.Random(4)
    say = lambda words: " ".join(rng.choice(words) for _ in range(40))
    words = {"aa": ["kimo", "tolu", "sana", "peri"], "bb": ["gruz", "vlesk", "brod", "hvan"], "cc": ["ûñè", "çeîx", "ôxa", "ïyû"]}
    rows = [(i, say(words[lang]), lang) for i in range(6000) for lang in ["cc" if i % 300 == 7 else "ab"[i % 2] * 2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.fit(docs, rows_per_language=50)
    assert network.languages == ["aa", "bb", "cc"]
    found = langid.identify(docs.where("lang = 'cc' or doc_id < 200"), network).collect()
    assert sum(r.lang == r.lang_pred for r in found) == len(found) and len(found) > 200


def test_sample_is_bounded_per_language(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid.ByteNetwork, "fit", lambda self, codes, y: taken.append([self.languages[i] for i in y]))
    rows = [(i, f"text {i}", "en" if i % 20 else "fr") for i in range(4000)] + [(9, "the same", "de")] * 90
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=20, windows_per_row=1)
    assert {x: taken[0].count(x) for x in ("de", "en", "fr")} == {"de": 20, "en": 20, "fr": 20}


def test_whole_table_against_a_naive_forward_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = langid.fit(docs)
    p = network.p

    def naive(text):
        raw, total = text.encode(), 0
        for i in range(0, max(len(raw), 1), network.window):
            x = p["emb"][list(raw[i : i + network.window].ljust(network.window))].astype("f8")
            pooled = []
            for w in network.widths:
                for f in range(p[f"conv{w}"].shape[2]):
                    answers = sum(x[j : len(x) - w + 1 + j] @ p[f"conv{w}"][j, :, f].astype("f8") for j in range(w))
                    pooled.append(max(0.0, answers.max() + p[f"b{w}"][f]))
            z = np.array(pooled) @ p["out"].astype("f8") + p["bias"]
            total = total + z - z.max() - np.log(np.exp(z - z.max()).sum())
        mean = total / max(1, -(-len(raw) // network.window))
        e = np.exp(mean - mean.max())
        return network.languages[int(e.argmax())], e.max() / e.sum()

    for r in langid.identify(docs.select("doc_id", "text"), network).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lang, score = naive(r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3
