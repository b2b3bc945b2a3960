"""Toxicity by averaged subword embeddings and a linear softmax, fitted jointly in numpy.

A word is the mean of the embeddings of its character n-grams (hashed) and of itself, a document the
mean of its words, and a softmax reads the document. A misspelt insult so shares most of its vector
with the right one. After the fit, a word's part in the result is one number, so scoring is a mean
of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.common import held_out, smallest, text_of

#: Words a worker remembers with their scores; beyond that it starts anew.
CACHED_WORDS = 500_000
CHUNK_CHARS = 2_000_000
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str) -> list[str]:
    return text.lower().split()


def subwords(words: list[str], sizes: tuple[int, ...], bits: int, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (of UTF-8 bytes, with marks at the ends) of all words in a row, and where each word's begin."""
    parts = [_subwords(words[i : i + at_once], sizes, bits) for i in range(0, len(words), at_once)]
    before = np.cumsum([0, *(len(ids) for ids, _ in parts[:-1])])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([begin + b for (_, begin), b in zip(parts, before, strict=True)])


def _subwords(words: list[str], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"<" + w.strip(STRIP).encode() + b">" for w in words]
    lengths = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), "u1").astype("u8")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    mix = lambda h, n: ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - bits)).astype("i4")
    owner = np.repeat(np.arange(len(raw)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(data))
    ids, owners = [], []
    for n in sizes:
        h = np.zeros(max(len(data) - n + 1, 0), "u8")
        for j in range(n):
            h = h * np.uint64(1_000_003) + data[j : j + len(h)]
        inside = left[: len(h)] >= n
        ids.append(mix(h[inside], n))
        owners.append(owner[: len(h)][inside])
    place = np.arange(len(data), dtype="u8") - np.repeat(starts, lengths).astype("u8")
    whole = np.add.reduceat(data * (place + np.uint64(1)) ** np.uint64(5), starts)
    ids.append(mix(whole, 0))
    owners.append(np.arange(len(raw)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(ids)[order], np.searchsorted(owners[order], np.arange(len(raw)))


class SubwordModel:
    def __init__(self, bits: int = 17, dim: int = 8, sizes: tuple[int, ...] = (3, 4, 5), scale: float = 300.0, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bits, self.sizes, self.scale = bits, sizes, scale
        self.emb = (rng.standard_normal((1 << bits, dim)) * 0.1).astype("f4")
        self.out = (rng.standard_normal((dim, 2)) * 0.5).astype("f4")
        self.bias = np.zeros(2, "f4")

    def fit(self, texts: list[str], labels: list[int], epochs: int = 6, batch: int = 64, rate: float = 0.02, least_z: float = 4.0, decay: float = 0.1) -> None:
        """Embeddings and softmax together, by Adam on the documents' log loss, both labels weighing alike.

        Subwords whose documents are toxic about as often as others (a z-score under ``least_z``) stay at
        zero: they are many, and would only learn the sample by heart.
        """
        index: dict[str, int] = {}
        docs = []
        for t in texts:
            ids, counts = np.unique([index.setdefault(w, len(index)) for w in words_of(t)], return_counts=True)
            docs.append((ids.astype("i8"), (counts / max(counts.sum(), 1)).astype("f4")))
        if not index:
            return
        grams, begin = subwords(list(index), self.sizes, self.bits)
        size = np.diff(np.append(begin, len(grams)))
        y = np.array(labels)
        frequency = np.zeros((2, len(self.emb)))
        for (ids, _), label in zip(docs, labels, strict=True):
            if len(ids):
                n, first = size[ids], np.cumsum(size[ids]) - size[ids]
                frequency[label, np.unique(grams[np.repeat(begin[ids] - first, n) + np.arange(n.sum())])] += 1
        total = np.maximum(np.bincount(y, minlength=2), 1)
        rates, common = frequency / total[:, None], frequency.sum(0) / total.sum()
        z = (rates[1] - rates[0]) / np.sqrt(np.maximum(common * (1 - common), 1e-9) * (1 / total).sum())
        telling = np.abs(z) >= least_z
        self.emb *= telling[:, None]
        # Only words with a telling subword move anything; the others count in the length of the text.
        kept = np.repeat(np.arange(len(begin), dtype="i4"), size)[telling[grams]]
        grams = grams[telling[grams]]
        begin, left = np.searchsorted(kept, np.arange(len(begin))), np.bincount(kept, minlength=len(begin))
        docs = [(ids[left[ids] > 0], share[left[ids] > 0]) for ids, share in docs]
        weight = (len(y) / (2 * total))[y].astype("f4")
        params = [self.emb, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                part, t = order[i : i + batch], t + 1
                words, share = np.concatenate([docs[d][0] for d in part]), np.concatenate([docs[d][1] for d in part])
                of = np.repeat(np.arange(len(part)), [len(docs[d][0]) for d in part])
                n = left[words]
                ids = grams[np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                pull = np.repeat(share / size[words], n) * np.float32(self.scale)  # of one subword on its document
                owner = np.repeat(of, n)
                mean = np.stack([np.bincount(owner, self.emb[ids, k] * pull, len(part)) for k in range(self.emb.shape[1])], 1)
                logits = mean @ self.out + self.bias
                e = np.exp(logits - logits.max(1, keepdims=True))
                d = e / e.sum(1, keepdims=True)
                d[np.arange(len(part)), y[part]] -= 1
                d *= weight[part][:, None] / len(part)
                back = d @ self.out.T
                g_emb = np.stack([np.bincount(ids, back[owner, k] * pull, len(self.emb)) for k in range(back.shape[1])], 1)
                self.emb *= np.float32(1 - rate * decay)
                for k, g in enumerate((g_emb, mean.T @ d, d.sum(0))):
                    m[k] = (0.9 * m[k] + 0.1 * g).astype("f4")
                    v[k] = (0.999 * v[k] + 0.001 * g * g).astype("f4")
                    params[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype("f4")

    def scorer(self) -> Scorer:
        return Scorer(((self.emb @ (self.out[:, 1] - self.out[:, 0])) * self.scale).astype("f4"), float(self.bias[1] - self.bias[0]), self.sizes, self.bits)


class Scorer:
    """The fitted model with one number per hashed n-gram, for scoring."""

    def __init__(self, weights: np.ndarray, bias: float, sizes: tuple[int, ...], bits: int):
        self.weights, self.bias, self.sizes, self.bits = weights, bias, sizes, bits
        self.known: dict[str, float] = {}

    def scores(self, texts: list[str]) -> list[float]:
        split = [words_of(t) for t in texts]
        used = set().union(*split)
        if len(self.known) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in used & self.known.keys()}
        if new := list(used - self.known.keys()):
            ids, begin = subwords(new, self.sizes, self.bits)
            means = np.add.reduceat(self.weights[ids].astype("f8"), begin) / np.diff(np.append(begin, len(ids)))
            self.known.update(zip(new, means.tolist(), strict=True))
        get = self.known.__getitem__
        z = np.array([self.bias + (sum(map(get, w)) / len(w) if w else 0.0) for w in split])
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = 1000, chars_per_row: int = 200_000, least_z: float = 4.0) -> SubwordModel:
    """A model learnt from at most ``rows_per_label`` documents of each label outside the held-out fifth.

    Those are the labelled ids with the smallest hashes; that short list is broadcast, so the documents
    are read where they lie. Of a text longer than ``chars_per_row`` that many characters are learnt from,
    at a hashed place; where an id is repeated, the texts with the smallest hashes count. Rows without a
    label or with a null text aren't taken. Without rows the model says 0.5 of every text.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isin(0, 1))
    marks = marks.withColumn("order", F.xxhash64(F.lit("fit"), "doc_id"))
    # Two bounded readings, one per label: at most 2 * rows_per_label ids.
    wanted = smallest(marks.where("toxic = 0"), "order", rows_per_label).union(smallest(marks.where("toxic = 1"), "order", rows_per_label)).drop("order")
    known = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(wanted), "doc_id")
    place = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.char_length("text") - chars_per_row + 1)) + 1
    part = F.substring("text", place.cast("int"), F.lit(chars_per_row))
    rows = known.select(F.xxhash64("text").alias("order"), part.alias("text"), "toxic").orderBy("order", "toxic").limit(2 * rows_per_label).collect()
    rows.sort(key=lambda r: (r.text, r.toxic))
    model = SubwordModel()
    if rows:
        model.fit([r.text for r in rows], [r.toxic for r in rows], least_z=least_z)
    else:
        model.out[:] = 0
    return model


def score(docs: DataFrame, model: SubwordModel, column: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 for the whole text.

    A null or empty text gets the score of a text about which nothing is known. Rows are kept one by
    one; a column ``score`` in ``docs`` is replaced. The model's table of n-grams (2 MB) is of a fixed size.
    """
    told = docs.sparkSession.sparkContext.broadcast(model.scorer())

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = told.value
        for series in texts:
            out, chunk, n = [], [], 0
            for t in series:
                chunk.append(t or "")
                n += len(chunk[-1])
                if n >= CHUNK_CHARS:
                    out += scorer.scores(chunk)
                    chunk, n = [], 0
            yield pd.Series(out + (scorer.scores(chunk) if chunk else []), dtype="float64")

    return docs.withColumn("score", scored(F.col(column)))


def predictions(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every document's toxicity, by a model fitted on a sample of the labelled others."""
    found = score(docs.select("doc_id", text_of().alias("text"), held_out().alias("held_out")), fit(docs, labels, **options))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
