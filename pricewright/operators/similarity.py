"""Similarity joins of names: blocking by trigrams or tokens, then exact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import names


def trigram_candidates(left: DataFrame, right: DataFrame, least_shared: int) -> DataFrame:
    """Pairs (left_id, right_id, shared) of names with ``least_shared`` or more trigrams in common.

    Both sides have a unique ``id`` and a normal ``name``. Of a name's ``n`` trigrams, the rarest first, two such names
    share one among their first ``n - least_shared + 1``, so only those are joined: the commonest trigrams of all names
    pair nobody, and no pair is lost. The shared ones are then counted exactly.
    """
    named = lambda df, to: df.select(F.col("id").alias(to), names.trigrams(F.col("name")).alias("grams")).where(F.size("grams") >= least_shared)
    sides = named(left, "left_id"), named(right, "right_id")
    each = [side.select(key, F.explode("grams").alias("gram")) for side, key in zip(sides, ("left_id", "right_id"), strict=True)]
    often = each[0].select("gram").unionByName(each[1].select("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    def rarest(grams: DataFrame, key: str) -> DataFrame:
        inorder = grams.join(often, "gram").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("g"))  # one name's trigrams
        return inorder.select(key, F.explode(F.slice("g", F.lit(1), F.size("g") - least_shared + 1)["gram"]).alias("gram"))

    met = rarest(each[0], "left_id").join(rarest(each[1], "right_id"), "gram").select("left_id", "right_id").distinct()
    both = met.join(sides[0].withColumnRenamed("grams", "l"), "left_id").join(sides[1].withColumnRenamed("grams", "r"), "right_id")
    return both.select("left_id", "right_id", F.size(F.array_intersect("l", "r")).alias("shared")).where(F.col("shared") >= least_shared)


def similarity_join(left: DataFrame, right: DataFrame, least: float, k: int, least_shared: int = 3, also: Column | None = None) -> DataFrame:
    """The ``k`` most similar right names of each left one with a similarity of ``least`` or more; ties to the smaller id."""
    pairs = trigram_candidates(left, right, least_shared)
    named = pairs.join(left.select(F.col("id").alias("left_id"), F.col("name").alias("left_name")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("name").alias("right_name")), "right_id")
    if also is not None:
        named = named.where(also)
    scored = named.withColumn("score", F.round(names.similarity(F.col("left_name"), F.col("right_name")), 6)).where(F.col("score") >= least)
    order = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("left_id", "right_id", "score", "rank")


def token_lane(query: Column, candidate: Column, threshold: float = 0.75) -> Column:
    """Length-weighted share of the query's tokens that some candidate token resembles by ``threshold``."""
    best = lambda t: F.array_max(F.transform(candidate, lambda c: names.similarity(t, c)))
    hit = F.aggregate(query, F.lit(0.0), lambda acc, t: acc + F.when(best(t) >= threshold, best(t) * F.length(t)).otherwise(0.0))
    size = F.aggregate(query, F.lit(0.0), lambda acc, t: acc + F.length(t))
    return F.when((F.size(query) == 0) | (F.size(candidate) == 0), 0.0).otherwise(hit / size)
