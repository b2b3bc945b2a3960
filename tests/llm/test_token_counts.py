import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricewright.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WEIRD = [" 's  'll 'l 'lx don't''s   x", "a   b\n\n\n  c  ", "x<|endoftext|>y <|endoftext|>", "'re're''ve !'s 'r 'v", "日本語 ١٢ \x01 é😀", "   x   y", "", None]


def counts(library, text):
    return [len(library.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def test_every_prefix(spark):
    library, r = Tokenizer.from_file(PATH), random.Random(3)
    texts = WEIRD + ["".join(r.choice(" \n\t'abcdelmrstv123!-éß日😀") for _ in range(50)) for _ in range(40)] + ["-" * 300]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, steps string")
    rows = token_counts.prefix_counts(df, PATH).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        want = counts(library, text)
        assert np.cumsum(np.frombuffer(row.steps, "i1"), dtype="i8").tolist() == want
        assert row.n_tokens == (want[-1] if want else 0) and row.n_bytes == len(text.encode())


def test_truncation(spark):
    library = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(1, "some words that are cut somewhere"), (2, ""), (2, "")], "doc_id long, text string")
    rows = df.join(token_counts.prefix_counts(df.dropDuplicates(["doc_id"]), PATH), "doc_id").select("text", token_counts.truncated(F.col("text"), F.col("steps"), 4).alias("head"), token_counts.tokens_of_prefix("steps", F.lit(6)).alias("six")).collect()
    for r in rows:
        want = counts(library, r.text)
        assert len(r.head) == max([i + 1 for i, n in enumerate(want) if n <= 4], default=0) and r.text.startswith(r.head)
        assert r.six == (want[min(6, len(want)) - 1] if want else 0)
    assert token_counts.prefix_counts(df.limit(0), PATH).count() == 0


def test_whole_table(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.prefix_counts(df, PATH).collect()} == want
