import random
import re
from collections import Counter

import numpy as np
import pytest

from pricewright.llm import substring_dedup


def brute(docs, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc_id, len(w), len(w) - len(kept), " ".join(kept)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("length,block", [(8, 20_000), (8, 3), (35, 20_000)])
def test_against_counting(spark, monkeypatch, length, block):
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", block)
    monkeypatch.setattr(substring_dedup, "SHARD_ANCHORS", block)
    r = random.Random(length)
    passages = [[r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randrange(length - 2, 3 * length))] for _ in range(6)]
    docs = [(None, None), (1, ""), (2, "a b"), (3, "z " * 300), (4, "x y " * (length // 2)), (4, "x y " * (length // 2))]
    for i in range(60):
        words = []
        for _ in range(r.randrange(4)):
            words += [f"u{r.randrange(10**6)}" for _ in range(r.randrange(12))]
            p = r.choice(passages)
            a = r.randrange(5)
            words += p[a : len(p) - r.randrange(5)]
        docs.append((10 + i, "\t".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "2 as anchor")
    same(substring_dedup.deduplicated(df, length).collect(), brute(docs, length))
    assert substring_dedup.deduplicated(df.limit(0), length).count() == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(substring_dedup.deduplicated(df).collect(), brute([tuple(r) for r in df.select("doc_id", "text").collect()], 35))


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(5)
    sizes = np.array([0, 3, 40, 7, 8, 120, 1])
    words = np.where(rng.random(sizes.sum()) < 0.8, 1, rng.integers(0, 12, sizes.sum())).astype("u8")
    owner, anchor, first, end, n = substring_dedup.segments(words, sizes, 8)
    assert (n >= 1).all() and (n > 1).any()
    covered = sorted((o, s) for o, f, e in zip(owner.tolist(), first.tolist(), end.tolist(), strict=True) for s in range(f, e - 7))
    assert covered == [(o, s) for o, n in enumerate(sizes.tolist()) for s in range(n - 7)]
    start, by_window = np.cumsum(sizes) - sizes, {}
    for o, a, f, e in zip(owner, anchor, first, end, strict=True):
        for s in range(f, e - 7):
            assert by_window.setdefault(tuple(words[start[o] + s : start[o] + s + 8]), a) == a


def test_rank():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 13, 500)
    tree = substring_dedup.WaveletTree(s, 4)
    at, c = rng.integers(0, 501, 200), rng.integers(0, 13, 200)
    assert tree.rank(c, at).tolist() == [int((s[:a] == x).sum()) for a, x in zip(at, c, strict=True)]
