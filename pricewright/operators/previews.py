"""A basket suggested to every user who has shopped enough: what they buy, and what everybody buys of the kinds they buy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import scores
from pricewright.functions.units import rounded_quantity


@dataclass(frozen=True)
class PreviewBars:
    """Windows in days, half-lives, and counts."""

    receipts: int = 3
    chains: int = 2
    personal_days: int = 90
    personal_half_life: float = 45.0
    global_days: int = 14
    wide_days: int = 90
    global_half_life: float = 7.0
    least_trips: int = 5
    tau: float = 5.0
    per_category: int = 2
    least_slots: int = 5
    most_slots: int = 25
    available_days: int = 45


def gates(receipts: DataFrame, bars: PreviewBars = PreviewBars()) -> DataFrame:
    """user_id, receipts, chains, qualified: three receipts from two chains; unknown chains don't count."""
    g = receipts.groupBy("user_id").agg(F.count_distinct("receipt_id").alias("receipts"), F.count_distinct("chain_id").alias("chains"))
    return g.withColumn("qualified", (F.col("receipts") >= bars.receipts) & (F.col("chains") >= bars.chains))


def global_window(bought: DataFrame, day: str, bars: PreviewBars = PreviewBars()) -> int:
    """The days that everybody's trips are taken from: the short window, or the wide one if it has too few trips."""
    recent = bought.where(_age(day).between(0, bars.global_days - 1)).select("user_id", "day").distinct()
    return bars.wide_days if len(recent.limit(bars.least_trips).collect()) < bars.least_trips else bars.global_days


def _age(day: str) -> Column:
    return F.datediff(F.lit(day).cast("date"), F.col("day"))


def previews(receipts: DataFrame, bought: DataFrame, products: DataFrame, seen: DataFrame, day: str, bars: PreviewBars = PreviewBars()) -> DataFrame:
    """user_id, place, product_id, source, quantity for every user who qualifies, as of ``day``.

    ``receipts``: user_id, receipt_id, chain_id. ``bought``: user_id, day, product_id, quantity. ``products``: product_id, category,
    weighable. ``seen``: product_id, day, the last day on which each was on offer or bought. Receipts of one user and day are one trip.

    Products that the user and others buy come first (by the blend of both decayed shares of trips, the user's weighing
    more with every trip), then those of one side alone (others' only in categories that the user buys, two each); ties by
    product_id. There are as many places as the user's usual trip is long, from 5 to 25. Products not seen for 45 days
    leave their place empty. The quantity is the user's median, else everybody's. Rows of the future don't count. What others buy
    is offered by category and rank, so a user meets two products of a category and those they know, not all.
    """
    c = F.col
    wide = global_window(bought, day, bars)
    aged = bought.withColumn("age", _age(day)).where(c("age") >= 0)
    mine = aged.where(c("age") < bars.personal_days).join(gates(receipts, bars).where("qualified").select("user_id"), "user_id")
    items = mine.select("user_id", "day", "age", "product_id").distinct()
    w = scores.half_life(c("age"), bars.personal_half_life)
    sizes = items.groupBy("user_id", "day", "age").agg(F.count("*").alias("size")).withColumn("w", w)
    repeated = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(4 * c("w") + 0.5)).cast("int"))))
    slots = repeated.groupBy("user_id").agg(F.floor(F.median("size") + 0.5).alias("m")).select("user_id", F.greatest(F.lit(bars.least_slots), F.least(F.lit(bars.most_slots), c("m"))).cast("int").alias("slots"))
    totals = sizes.groupBy("user_id").agg(F.sum("w").alias("total"), F.count("*").alias("trips"))
    personal = items.groupBy("user_id", "product_id").agg(F.sum(w).alias("w")).join(totals, "user_id").select("user_id", "product_id", F.round(c("w") / c("total"), 8).alias("p"), "trips")

    all_items = aged.where(c("age") < wide).select("user_id", "day", "age", "product_id").distinct()
    gw = scores.half_life(c("age"), bars.global_half_life)
    all_total = all_items.select("user_id", "day", "age").distinct().agg(F.sum(gw).alias("total"))  # one row
    popular = all_items.groupBy("product_id").agg(F.sum(gw).alias("w")).crossJoin(F.broadcast(all_total)).select("product_id", F.round(c("w") / c("total"), 8).alias("q"))

    kinds = products.select("product_id", "category", "weighable")
    known = personal.join(popular, "product_id", "left")
    blend = c("p") * (c("trips") / (c("trips") + bars.tau)) + c("q") * (1 - c("trips") / (c("trips") + bars.tau))
    own = known.select("user_id", "product_id", F.when(c("q").isNull(), "personal").otherwise("both").alias("source"), F.round(F.when(c("q").isNull(), c("p")).otherwise(blend), 8).alias("score"))
    in_category = Window.partitionBy("category").orderBy(F.desc("q"), "product_id")
    ranked = popular.join(kinds, "product_id").where("category IS NOT NULL").withColumn("g", F.row_number().over(in_category)).select("product_id", "category", "q", "g")
    shopped = personal.join(kinds, "product_id").where("category IS NOT NULL").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    # Of a category's list at most the user's own products come before the two to offer.
    offered = shopped.select("user_id", "category", F.explode(F.sequence(F.lit(1), c("n").cast("int") + bars.per_category)).alias("g")).join(ranked, ["category", "g"])
    fresh = offered.join(personal.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    capped = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "category").orderBy("g"))).where(c("rn") <= bars.per_category)
    others = capped.select("user_id", "product_id", F.lit("global").alias("source"), c("q").alias("score"))

    order = Window.partitionBy("user_id").orderBy((c("source") != "both"), F.desc("score"), "product_id")
    placed = own.unionByName(others).withColumn("place", F.row_number().over(order)).join(slots, "user_id").where("place <= slots")
    available = seen.where(_age(day).between(0, bars.available_days)).select("product_id").distinct()
    median = lambda rows, keys, to: rows.groupBy(*keys).agg(F.median("quantity").alias(to))
    usual = placed.join(available, "product_id").join(median(mine, ["user_id", "product_id"], "own_median"), ["user_id", "product_id"], "left")
    usual = usual.join(median(aged.where(c("age") < wide), ["product_id"], "all_median"), "product_id", "left").join(kinds.select("product_id", "weighable"), "product_id", "left")
    quantity = rounded_quantity(F.coalesce(F.nullif("own_median", F.lit(0.0)), F.nullif("all_median", F.lit(0.0)), F.lit(1.0)), F.coalesce("weighable", F.lit(False)))
    return usual.select("user_id", "place", "product_id", "source", quantity.alias("quantity"))
