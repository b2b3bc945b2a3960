"""What scanners take for what: edit operations along the best alignment of a print with the true name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.functions import names

#: Letters that a print may be longer than the part of the name that it is held against.
SLACK = 3


def aligned(a: str, b: str) -> list[tuple[str, str]]:
    """(read, true) of each edit on the way back from the end; '' where one side has no letter.

    A match or a substitution is taken before an invented letter, and that before a dropped one. A row of the table
    is filled at once: with the upper row known, what is left are insertions, a running minimum.
    """
    y = np.frombuffer(b.encode("utf-32-le"), "<u4")
    rows = [np.arange(len(b) + 1)]
    for i, ch in enumerate(a, 1):
        above = rows[-1]
        here = np.concatenate([[i], np.minimum(above[:-1] + (y != ord(ch)), above[1:] + 1)])
        rows.append(np.minimum.accumulate(here - rows[0]) + rows[0])
    ops, i, j = [], len(a), len(b)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] != b[j - 1]:
                ops.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            ops.append((a[i - 1], ""))
            i -= 1
        else:
            ops.append(("", b[j - 1]))
            j -= 1
    return ops


def confusions(pairs: DataFrame, least_similarity: float = 0.65, least_count: int = 2) -> DataFrame:
    """read, truth, kind, n: how often a letter was read for another (``swap``), dropped or invented.

    ``pairs`` has ``print`` and ``name``. Both are folded, with one blank between words. Prints are often cut off, so the name
    counts up to three letters beyond the print's length. Pairs that are less alike are two products, and don't count; nor do
    empty ones. Equal pairs are aligned once and weigh as often as they occur; swaps are listed from ``least_count`` on.
    """
    plain = lambda c: F.trim(F.regexp_replace(names.folded(F.col(c)), r"\s+", " "))
    folded = pairs.select(plain("print").alias("a"), plain("name").alias("b")).where("length(a) > 0 AND length(b) > 0")
    cut_off = folded.select("a", F.substring("b", F.lit(1), F.length("a") + SLACK).alias("b"))
    distinct = cut_off.groupBy("a", "b").agg(F.count("*").alias("n"))
    alike = distinct.where(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) >= least_similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple[str, str], int] = {}
            for a, b, n in zip(pdf["a"], pdf["b"], pdf["n"], strict=True):
                for op in aligned(a, b):
                    sums[op] = sums.get(op, 0) + int(n)
            yield pd.DataFrame([(x, y, n) for (x, y), n in sums.items()], columns=["read", "truth", "n"]).astype({"n": "int64"})

    kind = F.when(F.col("read") == "", "dropped").when(F.col("truth") == "", "invented").otherwise("swap")
    counted = alike.where("a != b").mapInPandas(run, "read string, truth string, n long").groupBy("read", "truth").agg(F.sum("n").alias("n"))
    return counted.withColumn("kind", kind).where((F.col("kind") != "swap") | (F.col("n") >= least_count))
