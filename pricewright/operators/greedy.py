"""Choices made one after the other inside bounded groups (a user's slots, a trip's lines)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILLED = "user_id long, slot int, product_id long"
#: Products apart by less may tie, as values are compared to the ninth digit.
NEAR = 1e-8


def worth_asking(p: dict[int, float], in_pairs: set[int], slots: int) -> dict[int, float]:
    """Of a user's products those that can be chosen: all that stand in a pair, and of the others the first ``slots``.

    What has no pair is worth its p in every round, so only the greatest of these, then the least ids, can come up. If one
    without a pair nearly ties with the last of them, all are kept.
    """
    alone = sorted((-v, i) for i, v in p.items() if i not in in_pairs)
    if len(alone) > slots:
        last = alone[slots - 1][0]
        if not any(v != last and abs(v - last) < NEAR for v, _ in alone):
            alone = alone[:slots]
    return {i: v for i, v in p.items() if i in in_pairs} | {i: -v for v, i in alone}


def greedy_fill(candidates: DataFrame, pairs: DataFrame, slots: int) -> DataFrame:
    """Fills each user's ``slots`` one by one with the product of the greatest p * (1 + sum of pair scores with those chosen).

    ``candidates`` has user_id, product_id, p; ``pairs`` a < b and score. Ties go to the least id. Only the
    pairs between a user's own candidates reach that user's group, found by joins beforehand, so a
    group is as large as one user's list of candidates. Of its products without a pair only as many as there are
    slots are looked at in every round.
    """
    mine = candidates.groupBy("user_id").agg(F.collect_list(F.struct("product_id", "p")).alias("items"))
    a = candidates.select("user_id", F.col("product_id").alias("a")).join(pairs, "a")
    own = a.join(candidates.select("user_id", F.col("product_id").alias("b")), ["user_id", "b"]).groupBy("user_id").agg(F.collect_list(F.struct("a", "b", "score")).alias("pairs"))

    def fill(batches):
        for pdf in batches:
            rows = []
            for user, ids, ps, a, b, scores in zip(*(pdf[c] for c in pdf.columns), strict=True):
                score = {} if a is None else dict(zip(zip(a.tolist(), b.tolist(), strict=True), scores.tolist(), strict=True))
                left = worth_asking(dict(zip(ids.tolist(), ps.tolist(), strict=True)), {i for pair in score for i in pair}, slots)
                bonus = dict.fromkeys(left, 0.0)
                for slot in range(min(slots, len(left))):
                    best = min(left, key=lambda i: (-round(left[i] * (1 + bonus[i]), 9), i))
                    rows.append((user, slot + 1, best))
                    del left[best]
                    for i in left:
                        bonus[i] += score.get((min(i, best), max(i, best)), 0.0)
            yield pd.DataFrame(rows, columns=["user_id", "slot", "product_id"]).astype({"user_id": "int64", "slot": "int32", "product_id": "int64"})

    # Flat arrays: structs would come to Python as one dict each.
    flat = [F.col(c) for c in ("items.product_id", "items.p", "pairs.a", "pairs.b", "pairs.score")]
    return mine.join(own, "user_id", "left").select("user_id", *(c.alias(f"c{i}") for i, c in enumerate(flat))).mapInPandas(fill, FILLED)
