"""Edit distance in which characters that scanners confuse cost little."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Pairs that look alike on receipts, and what taking one for the other costs.
ONE_FOR_ONE = [
    ("0", "o", 0.10), ("1", "i", 0.15), ("1", "l", 0.15), ("5", "s", 0.20), ("8", "b", 0.20), ("4", "a", 0.25),
    ("2", "z", 0.20), ("6", "b", 0.35), ("6", "g", 0.35), ("9", "g", 0.35), ("7", "t", 0.40), ("3", "e", 0.40),
    ("0", "c", 0.45), ("i", "l", 0.30), ("i", "j", 0.45), ("c", "e", 0.45), ("u", "v", 0.35), ("n", "h", 0.45),
]
SEVERAL = [
    ("rn", "m", 0.30), ("cl", "d", 0.35), ("vv", "w", 0.30), ("ll", "u", 0.40), ("ll", "ti", 0.40), ("ii", "u", 0.40),
    ("nn", "m", 0.40), ("rn", "nn", 0.45),
]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one table, padded with 0, and their lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    table = np.zeros((len(texts), int(sizes.max(initial=0))), dtype=np.int64)
    for row, text in zip(table, texts, strict=True):
        row[: len(text)] = [ord(c) for c in text]
    return table, sizes


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of many pairs at once: one table of costs per pair, filled cell by cell for all of them together."""
    (a, na), (b, nb) = _codes(left), _codes(right)
    rows, n, m = len(left), a.shape[1], b.shape[1]
    cost = np.empty((n + 1, m + 1, rows))
    cost[:, 0], cost[0, :] = np.arange(n + 1)[:, None], np.arange(m + 1)[:, None]
    both = [(x, y, c) for one, other, c in ONE_FOR_ONE + SEVERAL for x, y in ((one, other), (other, one))]

    def ends(table: np.ndarray, at: int, piece: str) -> np.ndarray:
        return np.logical_and.reduce([table[:, at - len(piece) + k] == ord(ch) for k, ch in enumerate(piece)])

    ends_a = {(i, x): ends(a, i, x) for i in range(1, n + 1) for x in {x for x, _, _ in both} if i >= len(x)}
    ends_b = {(j, y): ends(b, j, y) for j in range(1, m + 1) for y in {y for _, y, _ in both} if j >= len(y)}
    live_a = {k: v for k, v in ends_a.items() if v.any()}
    live_b = {k: v for k, v in ends_b.items() if v.any()}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cell = np.minimum(cost[i - 1, j] + 1, cost[i, j - 1] + 1)
            np.minimum(cell, cost[i - 1, j - 1] + (a[:, i - 1] != b[:, j - 1]), out=cell)
            for x, y, c in both:
                if (i, x) in live_a and (j, y) in live_b:
                    there = live_a[i, x] & live_b[j, y]
                    cell = np.where(there, np.minimum(cell, cost[i - len(x), j - len(y)] + c), cell)
            cost[i, j] = cell
    return cost[na, nb, np.arange(rows)]


@pandas_udf(DoubleType())
def lookalike_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insertions and deletions cost 1, as do substitutions but for look-alikes; null if either text is null.

    Pairs are taken 4096 at a time, and fewer where texts are long, as all their tables are held at once.
    """
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    known = known[np.argsort([len(a.iat[i]) * len(b.iat[i]) for i in known], kind="stable")] if len(known) else known
    at = 0
    while at < len(known):
        n = 4096
        while n > 1:
            part = known[at : at + n]
            if (max(len(a.iat[i]) for i in part) + 1) * (max(len(b.iat[i]) for i in part) + 1) * len(part) <= 8_000_000:
                break
            n //= 2
        part = known[at : at + n]
        out[part] = distances([a.iat[i] for i in part], [b.iat[i] for i in part])
        at += n
    return pd.Series(out).astype("Float64").where(~pd.isna(out), None)
