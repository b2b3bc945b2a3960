"""Basket pricing: canonical units, packs, stores, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions.units import base_amount, family, money

COUNT_UNITS = ("vnt", "pak", "rit")


def canonical_units(sp: DataFrame) -> DataFrame:
    """product_id, family, unit, step: how amounts of a product are shown and stepped.

    The family with more store products wins, fluid on a tie. Within fluid litres need a strict majority
    over kilograms; within count the most frequent unit, vnt before pak before rit. The step is the
    smallest pack; 0.1 at most if something is sold by weight, else 0.5 at least if there are several
    sizes. A fluid product of a single size that isn't sold by weight becomes one ``vnt``.
    """
    u = F.lower(F.col("unit"))
    base = base_amount(F.col("amount"), F.col("unit"))
    good = F.col("amount") > 0
    votes = [F.count(F.when(u == x, 1)).alias(f"n_{x}") for x in COUNT_UNITS]
    counted = [F.min(F.when((u == x) & good, F.col("amount"))).alias(f"least_{x}") for x in COUNT_UNITS]
    is_fluid = family(F.col("unit")) == "fluid"
    g = sp.groupBy("product_id").agg(
        F.count(F.when(is_fluid, 1)).alias("n_fluid"),
        F.count(F.when(family(F.col("unit")) == "count", 1)).alias("n_count"),
        F.count(F.when(u.isin("l", "ml"), 1)).alias("n_l"),
        F.count(F.when(u.isin("kg", "g"), 1)).alias("n_kg"),
        F.min(F.when(is_fluid & good, base)).alias("least_fluid"),
        F.size(F.collect_set(F.when(is_fluid & good, F.floor(base * 1000 + 0.5)))).alias("sizes"),
        F.max(is_fluid & F.col("weighable")).alias("by_weight"),
        *votes, *counted,
    )
    g = g.where("n_fluid + n_count > 0")
    fluid = F.col("n_fluid") >= F.col("n_count")
    best = F.greatest(*(F.col(f"n_{x}") for x in COUNT_UNITS))
    count_unit = F.when(F.col("n_vnt") == best, "vnt").when(F.col("n_pak") == best, "pak").otherwise("rit")
    count_step = F.when(count_unit == "vnt", F.col("least_vnt")).when(count_unit == "pak", F.col("least_pak")).otherwise(F.col("least_rit"))
    least = F.coalesce("least_fluid", F.lit(1.0))
    fluid_step = F.when(F.col("by_weight"), F.least(least, F.lit(0.1))).when(F.col("sizes") > 1, F.greatest(least, F.lit(0.5))).otherwise(least)
    single = fluid & ~F.coalesce("by_weight", F.lit(False)) & (F.col("sizes") <= 1)
    return g.select(
        "product_id",
        F.when(fluid & ~single, "fluid").otherwise("count").alias("family"),
        F.when(single, "vnt").when(fluid, F.when(F.col("n_l") > F.col("n_kg"), "l").otherwise("kg")).otherwise(count_unit).alias("unit"),
        F.when(single, 1.0).when(fluid, fluid_step).otherwise(F.coalesce(count_step, F.lit(1.0))).alias("step"),
    )


def canonical_amount(amount: Column, unit: Column, to_family: Column, to_unit: Column) -> Column:
    """An amount in the canonical unit; null if it is of another family or another count unit."""
    own = family(unit)
    return (
        F.when((to_family == "count") & (to_unit == "vnt") & (own == "fluid"), 1.0)
        .when(own != to_family, None)
        .when(to_family == "fluid", base_amount(amount, unit))
        .when(F.lower(unit) == to_unit, amount)
    )


def total_for(quantity: Column, price: Column, amount: Column, weighable: Column) -> Column:
    """What a wanted quantity costs: by weight in proportion, else in whole packs, one at least."""
    return F.when(weighable, quantity * price / amount).otherwise(F.greatest(F.lit(1), F.ceil(quantity / amount)) * price)


def cheapest_for(offers: DataFrame, keys: list[str]) -> DataFrame:
    """The offer with the least total per key; the smaller sp_id on a tie. ``offers`` has quantity, eff, amount, weighable, sp_id."""
    total = F.round(total_for(F.col("quantity"), F.col("eff"), F.col("amount"), F.col("weighable")), 6)
    priced = offers.withColumn("total", total)
    rest = [c for c in priced.columns if c not in (*keys, "total", "sp_id")]
    best = priced.groupBy(*keys).agg(F.min(F.struct("total", "sp_id", *rest)).alias("best"))
    return best.select(*keys, "best.*")


def substitutes(items: DataFrame, catalog: DataFrame, least: float = 0.5, most: int = 8) -> DataFrame:
    """What can stand in for each item: item_id, sp_id, score; the ``most`` best, ties to the smaller sp_id.

    ``items`` has item_id, ``catalog`` sp_id, name, category, unit, product_id. A substitute is of the item's
    category and unit family but another product, and its name has at least ``least`` of the item's words.
    Only names that share a word with an item's meet, so the work grows with the catalog.
    """
    counted = lambda unit: family(unit) == "count"
    asked = items.select("item_id").distinct().join(catalog.select(F.col("sp_id").alias("item_id"), F.array_distinct(F.split("name", " ")).alias("words"), "category", counted(F.col("unit")).alias("counted"), F.col("product_id").alias("own")), "item_id")
    asked = asked.select("item_id", "category", "counted", "own", F.size("words").alias("n"), F.explode("words").alias("word"))
    offered = catalog.select("sp_id", "category", counted(F.col("unit")).alias("counted"), "product_id", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    shared = asked.join(offered, ["category", "counted", "word"]).where("own != product_id").groupBy("item_id", "sp_id", "n").agg(F.count("*").alias("k"))
    scored = shared.select("item_id", "sp_id", F.round(F.col("k") / F.col("n"), 6).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "sp_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def store_totals(items: DataFrame, wanted: int | Column) -> DataFrame:
    """Per store: how many of the wanted items are missing, replaced or averaged, and the total; best store first."""
    tier = F.col("tier")
    sums = items.groupBy("store_id").agg(
        F.count("*").alias("n_found"),
        F.count(F.when(tier == 3, 1)).alias("n_substituted"),
        F.count(F.when(tier == 4, 1)).alias("n_averaged"),
        F.sum(F.floor(F.col("total") * 100 + 0.5).cast("long")).alias("cents"),
    )
    return sums.select("store_id", (F.lit(wanted) - F.col("n_found")).alias("n_missing"), "n_averaged", "n_substituted", (F.col("cents") / 100).alias("total"))


def fine_mean(price: str) -> Column:
    """Mean of prices to a hundredth of a cent, summed in whole cents so that no order of summing matters."""
    return F.floor(F.sum(F.round(F.col(price) * 100).cast("long")) * 100 / F.count("*") + 0.5) / 10000


def real_discount(offers: DataFrame, most_spread: float = 5) -> DataFrame:
    """Per product, from each chain's least unit price: how far the least is below the mean of chains, in percent.

    Two chains at least; a spread of more than ``most_spread`` times is taken for a wrong size and gives no row.
    """
    by_chain = offers.groupBy("product_id", "chain_id").agg(F.min("unit_price").alias("unit_price"))
    g = by_chain.groupBy("product_id").agg(F.min("unit_price").alias("least"), F.max("unit_price").alias("most"), F.round(F.avg("unit_price"), 6).alias("mean"), F.count("*").alias("chains"))
    g = g.where((F.col("chains") >= 2) & (F.col("most") <= most_spread * F.col("least")))
    return g.select("product_id", "chains", money(F.col("least")).alias("least"), F.floor((F.col("mean") - F.col("least")) / F.col("mean") * 100 + 0.5).cast("int").alias("percent"))
