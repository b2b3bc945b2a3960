"""One-to-one pairing of what was planned with what was bought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("product", "name", "category")


def gathered(lines: DataFrame, key: str) -> DataFrame:
    """key, lines: each key's lines (id, product_id, words, category) by ascending id; repeated ids are taken once."""
    known = lines.where(F.col(key).isNotNull())
    line = F.struct(F.col("id").cast("long").alias("id"), "product_id", "words", "category")
    found = known.groupBy(F.col(key).alias(key)).agg(F.sort_array(F.collect_list(line)).alias("_all"))
    first = lambda x, i: (i == 0) | ~x["id"].eqNullSafe(F.get("_all", i - 1)["id"])
    return found.select(key, F.filter("_all", first).alias("lines"))


def matches(ours: Column, theirs: Column, unassigned: str) -> Column:
    """All ways in which two lines match, best first: (tier, less the score, planned, bought)."""

    def of(a: Column, b: Column) -> Column:
        way = lambda tier, score: F.struct(F.lit(tier).alias("tier"), (-score).cast("int").alias("less"), a["id"].alias("a"), b["id"].alias("b"))
        shared = F.size(F.array_intersect(a["words"], b["words"]))
        product = F.when(a["product_id"] == b["product_id"], way(0, F.lit(1)))
        category = F.when((a["category"] == b["category"]) & (a["category"] != unassigned), way(2, F.lit(1)))
        return F.filter(F.array(product, F.when(shared > 0, way(1, shared)), category), lambda x: x.isNotNull())

    return F.sort_array(F.flatten(F.flatten(F.transform(ours, lambda a: F.transform(theirs, lambda b: of(a, b))))))


def paired_groups(groups: DataFrame, key: str, unassigned: str) -> DataFrame:
    """As ``paired``, for one row a key with its lines as ``ours`` and ``theirs``."""
    none = F.array().cast("array<struct<tier:int,less:int,a:bigint,b:bigint>>")
    taken = lambda acc, x: F.exists(acc, lambda o: o["a"].eqNullSafe(x["a"]) | o["b"].eqNullSafe(x["b"]))
    chosen = F.aggregate(matches(F.col("ours"), F.col("theirs"), unassigned), none, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("x.tier") + 1)
    return groups.select(key, F.explode(chosen).alias("x")).select(F.col(key).cast("long").alias(key), F.col("x.a").alias("planned_id"), F.col("x.b").alias("bought_id"), tier.alias("tier"))


def paired(planned: DataFrame, bought: DataFrame, key: str, unassigned: str) -> DataFrame:
    """Pairs of lines within each ``key``: columns key, planned_id, bought_id, tier.

    Both sides have ``key``, ``id``, ``product_id``, ``words``, ``category``. The same product claims its line
    first, then most shared words, then one category (but ``unassigned``); within a tier the better score goes
    first, ties by the smaller ids. A key's lines are one list and one receipt, so each side's array is small.
    Keys that are null or on one side only give no pair; repeated ids are taken once.
    """
    ours, theirs = (gathered(side, key).withColumnRenamed("lines", to) for side, to in ((planned, "ours"), (bought, "theirs")))
    return paired_groups(ours.join(theirs, key), key, unassigned)
