"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter keeps
its strongest answer, and a softmax reads those. The network is fitted in numpy on a bounded sample
of labelled windows; texts are then cut whole into windows, scored in batches, and a document gets
the languages' mean log probability over its windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewright.llm.common import held_out, text_of

#: Texts are cut into windows so many bytes at a time, and one by one beyond that.
CHUNK_BYTES = 4_000_000
#: What no learned language is said of.
UNDETERMINED = "und"


class ByteNetwork:
    """``widths`` filter widths with ``filters`` each over ``dim``-dimensional bytes."""

    def __init__(self, languages: list[str], window: int = 256, widths: tuple[int, ...] = (2, 3, 4), filters: int = 24, dim: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.window, self.widths = languages, window, widths
        normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype("f4")
        self.p = {"emb": normal(256, dim, s=0.5), "out": normal(len(widths) * filters, len(languages), s=0.1), "bias": np.zeros(len(languages), "f4")}
        for w in widths:
            self.p[f"conv{w}"] = normal(w, dim, filters, s=(w * dim) ** -0.5)
            self.p[f"b{w}"] = np.zeros(filters, "f4")

    def _pooled(self, codes: np.ndarray, where: bool = False):
        out, at = [], []
        for w in self.widths:
            taps = self.p["emb"] @ self.p[f"conv{w}"]  # the answer to each byte at each place of the filter
            n = codes.shape[1] - w + 1
            s = taps[0][codes[:, :n]]
            for j in range(1, w):
                s += taps[j][codes[:, j : j + n]]
            if where:
                at.append(s.argmax(1))
            out.append(s.max(1) + self.p[f"b{w}"])
        return np.maximum(np.concatenate(out, 1), 0), at

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        pooled, _ = self._pooled(codes)
        z = pooled @ self.p["out"] + self.p["bias"]
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pooled, at = self._pooled(codes, where=True)
        z = pooled @ self.p["out"] + self.p["bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= (weight / weight.sum())[:, None]
        g = {"out": pooled.T @ d, "bias": d.sum(0), "emb": np.zeros_like(self.p["emb"])}
        back, done = (d @ self.p["out"].T) * (pooled > 0), 0
        for w, best in zip(self.widths, at, strict=True):
            conv = self.p[f"conv{w}"]
            part = back[:, done : done + conv.shape[2]]
            done += conv.shape[2]
            g[f"b{w}"], g[f"conv{w}"] = part.sum(0), np.zeros_like(conv)
            for j in range(w):
                seen = np.take_along_axis(codes, best + j, 1)  # (windows, filters): the byte under this place
                g[f"conv{w}"][j] = np.einsum("nfd,nf->df", self.p["emb"][seen], part)
                np.add.at(g["emb"], seen, part[:, :, None] * conv[j].T[None])
        return g

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> None:
        rng = np.random.default_rng(5)
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.languages)), 1))[y]
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for _ in range(max(epochs, -(-300 * batch // max(len(y), 1)) if len(y) < 50 * batch else epochs)):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                part, t = order[i : i + batch], t + 1
                for k, g in self.gradients(codes[part], y[part], weight[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype("f4")


def windows_of(raw: bytes, window: int) -> np.ndarray:
    """All of ``raw`` in rows of ``window`` bytes; the last row is filled up with spaces."""
    n = max(1, -(-len(raw) // window))
    return np.frombuffer(raw.ljust(n * window), "u1").reshape(n, window)


def labelled(docs: DataFrame) -> DataFrame:
    """The labelled documents with a letter: doc_id, text, lang."""
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def fit(docs: DataFrame, rows_per_language: int = 1000, windows_per_row: int = 4, window: int = 256) -> ByteNetwork | None:
    """A network learnt from at most ``rows_per_language`` labelled documents of each language outside the held-out fifth.

    Those are the rows with the smallest hashes of their ids; a count of the languages tells below which
    hash about twice as many lie, so that tasks pass few rows on. From each come ``windows_per_row``
    windows at hashed places, so what the driver gets is bounded in bytes too, for each language. Rows whose
    language or text is null, or whose text has no letter, aren't taken; none at all gives no network.
    """
    raw = F.encode("text", "utf-8")
    place = lambda i: (F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.greatest(F.lit(1), F.octet_length("text") - window + 1)) + 1).cast("int")
    known = labelled(docs).where(~held_out())
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return None
    sample = known.select("doc_id", "lang", F.array(*(F.substring(raw, place(i), F.lit(window)) for i in range(windows_per_row))).alias("windows"), F.xxhash64(F.lit("fit"), "doc_id", "text").alias("order"))

    def smallest_of(rows: DataFrame) -> list:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= rows_per_language).drop("rank").collect()

    share = {x: 2 * rows_per_language / n for x, n in totals.items()}
    bounds = F.create_map(*(F.lit(v) for x in languages for v in (x, -(2**63) + int(2**64 * share[x]) if share[x] < 0.5 else 2**63 - 1)))
    rows = smallest_of(sample.where(F.col("order") <= bounds[F.col("lang")]))
    got = Counter(r.lang for r in rows)
    if short := [x for x in languages if got[x] < min(rows_per_language, totals[x])]:  # equal rows have equal hashes
        rows = [r for r in rows if r.lang not in short] + smallest_of(sample.where(F.col("lang").isin(short)))
    rows.sort(key=lambda r: (r.order, r.lang))
    codes = np.concatenate([windows_of(bytes(x), window)[:1] for r in rows for x in r.windows])
    network = ByteNetwork(languages, window)
    network.fit(codes, np.array([languages.index(r.lang) for r in rows for _ in r.windows]))
    return network


def identify(docs: DataFrame, network: ByteNetwork | None, column: str = "text", batch: int = 512) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language.

    Whole texts are read, in windows of fixed length, ``batch`` windows at a time. A text that is null or
    has no letter, and any text without a network, is ``und`` with score 0. Rows are kept one by
    one; columns of those two names in ``docs`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    said = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if network is not None:

        def chunks(series: pd.Series) -> Iterator[list[np.ndarray]]:
            parts, n = [], 0
            for t in series:
                parts.append(windows_of((t or "").encode(), network.window))
                n += parts[-1].size
                if n >= CHUNK_BYTES:
                    yield parts
                    parts, n = [], 0
            if parts:
                yield parts

        @F.pandas_udf("lang_pred string, score double")
        def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in texts:
                names, scores = [], []
                for parts in chunks(series):
                    sums = np.zeros((len(parts), len(network.languages)))
                    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                    codes = np.concatenate(parts)
                    for i in range(0, len(codes), batch):
                        np.add.at(sums, owner[i : i + batch], network.log_probabilities(codes[i : i + batch]))
                    mean = sums / np.bincount(owner, minlength=len(parts))[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    names += [network.languages[b] for b in best]
                    scores += p[np.arange(len(p)), best].tolist()
                yield pd.DataFrame({"lang_pred": names, "score": scores})

        found = predict(F.when(F.col(column).rlike(r"\p{L}"), F.col(column)))
        said = F.when(F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False)), found).otherwise(said)
    return docs.withColumn("_said", said).select(*docs.columns, "_said.lang_pred", "_said.score")


def predictions(docs: DataFrame, **options) -> DataFrame:
    """Every document's predicted language, by a network fitted on a sample of the others."""
    found = identify(docs.select("doc_id", text_of().alias("text"), held_out().alias("held_out")), fit(docs, **options))
    return found.select("doc_id", "held_out", "lang_pred", "score")
