"""Upsert of scraped offers: place each in the catalog, follow its codes, and write its price to the chain's stores.

The stages are exclusive: an exact listing first, then the matcher's decision, then a new product. What an offer
writes hangs on the state before the batch; the same listing twice in a batch makes one new product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.operators.lines import same_size_in, with_found

#: The shape of a chain's product code, after its leading zeros are gone.
CODE = r"^\d{3,16}$"
EQUAL = 0.001


def placed(offers: DataFrame, catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """``offers`` with via, sp_id, product_id, category, review, made and key.

    ``offers`` has offer_id (unique), chain_id, name, amount and unit; ``catalog`` sp_id, product_id, chain_id, name,
    amount, unit and has_image; ``matches`` offer_id, via, sp_id (the product to take or to join) and category.
    via is ``exact`` where the chain lists the very name and size, else the match's. made is ``sp`` for a new
    listing of a known product, ``product`` for a new product, else null; review marks products in a borrowed
    category; ``key`` tells listings apart, new ones by chain, name and size. An offer without a match makes a new product.
    """
    c = F.col
    df = offers.withColumn("low_name", F.lower("name"))
    listed = catalog.select("sp_id", "chain_id", F.lower("name").alias("low_name"), "amount", "unit", (~F.coalesce("has_image", F.lit(False))).alias("bare"))
    df = with_found(df, same_size_in(df, listed, ["chain_id", "low_name"], ["bare"]), ["chain_id", "low_name"], "exact_id")
    matched = matches.select(c("offer_id"), c("via").alias("match_via"), c("sp_id").alias("match_id"), c("category").alias("match_category"))
    df = df.join(matched, "offer_id", "left")
    via = F.when(c("exact_id").isNotNull(), "exact").otherwise(F.coalesce("match_via", F.lit("uncategorised")))
    df = df.withColumn("via", via).withColumn("sp_id", F.coalesce("exact_id", F.when(c("via") == "chain_sp", c("match_id"))))
    known = catalog.select(c("sp_id").alias("known_id"), c("product_id"))
    df = df.join(known, F.coalesce("sp_id", "match_id") == c("known_id"), "left")
    made = F.when(c("sp_id").isNotNull(), None).when((c("via") == "join") & c("product_id").isNotNull(), "sp").otherwise("product")
    new_key = F.to_json(F.struct("chain_id", "low_name", "amount", "unit"))
    df = df.withColumn("made", made).withColumn("key", F.coalesce(c("sp_id").cast("string"), new_key))
    df = df.withColumn("product_id", F.when(F.coalesce(c("made") != "product", F.lit(True)), c("product_id")))
    df = df.withColumn("category", F.when(c("made") == "product", c("match_category"))).withColumn("review", F.coalesce((c("made") == "product") & (c("via") == "mint_borrowed"), F.lit(False)))
    return df.drop("low_name", "exact_id", "match_via", "match_id", "match_category", "known_id")


def code_actions(offers: DataFrame, codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """offer_id, chain_id, code, key, old_id, action for each of an offer's codes.

    ``offers`` are placed ones with an array ``codes``; ``codes`` maps (chain_id, code) to one sp_id each. action: ``insert`` for an
    unknown code, ``confirm`` if it leads to this listing, ``merge`` if it leads to another one of the same amount
    (one listing from two sources), else ``move`` (a new pack size). Codes of other shapes are left out.
    """
    c = F.col
    said = F.array_distinct(F.filter(F.transform("codes", lambda x: F.regexp_replace(x, "^0+", "")), lambda x: x.rlike(CODE)))
    each = offers.select("offer_id", "chain_id", "key", "amount", c("sp_id").alias("new_id"), F.explode(said).alias("code"))
    sizes = catalog.select(c("sp_id").alias("sized_id"), c("amount").alias("listed_amount"))
    each = each.join(sizes, c("new_id") == c("sized_id"), "left").withColumn("amount", F.when(c("new_id").isNotNull(), c("listed_amount")).otherwise(c("amount"))).drop("sized_id", "listed_amount")
    mapped = codes.select(c("chain_id"), c("code"), c("sp_id").alias("old_id")).join(catalog.select(c("sp_id").alias("old_id"), c("amount").alias("old_amount")), "old_id", "left")
    same = (c("amount").isNull() & c("old_amount").isNull()) | F.coalesce(F.abs(c("amount") - c("old_amount")) < EQUAL, F.lit(False))
    action = F.when(c("old_id").isNull(), "insert").when(c("key") == c("old_id").cast("string"), "confirm").when(same, "merge").otherwise("move")
    return each.join(mapped, ["chain_id", "code"], "left").select("offer_id", "chain_id", "code", "key", "old_id", action.alias("action"))


def price_writes(offers: DataFrame, latest: DataFrame, stores: DataFrame) -> DataFrame:
    """offer_id, store_id, action for each store of an offer's chain: ``insert``, ``extend`` (only the end moves later) or ``keep``.

    ``offers`` are placed ones with price, promo_price, promo_start, promo_end and coupon; ``latest`` has the last
    price of each (sp_id, store_id) in columns of the same names. An offer of a chain without stores has no rows.
    """
    c = F.col
    wide = offers.select("offer_id", "chain_id", "sp_id", "price", "promo_price", "promo_start", "promo_end", "coupon").join(stores.select("chain_id", "store_id"), "chain_id")
    was = latest.select(c("sp_id").alias("was_sp"), c("store_id").alias("was_store"), *(c(x).alias(f"was_{x}") for x in ("price", "promo_price", "promo_start", "promo_end", "coupon")))
    near = lambda a, b: F.abs(a - b) < EQUAL
    same_promo = (c("promo_price").isNull() & c("was_promo_price").isNull()) | F.coalesce(near(c("promo_price"), c("was_promo_price")), F.lit(False))
    coupon = lambda x: F.coalesce(c(x), F.lit(False))
    same = near(c("price"), c("was_price")) & same_promo & (coupon("coupon") == coupon("was_coupon")) & c("promo_start").eqNullSafe(c("was_promo_start"))
    later = c("promo_end") > c("was_promo_end")
    action: Column = F.when(~F.coalesce(same, F.lit(False)), "insert").when(F.coalesce(later, F.lit(False)), "extend").otherwise("keep")
    return wide.join(was, (c("sp_id") == c("was_sp")) & (c("store_id") == c("was_store")), "left").select("offer_id", "store_id", action.alias("action"))


def upserted(offers: DataFrame, catalog: DataFrame, matches: DataFrame, codes: DataFrame, latest: DataFrame, stores: DataFrame) -> DataFrame:
    """One row for each offer: what became of it and how many codes and prices it wrote.

    Beside the columns of the stages ``offers`` has has_image and name_authority. renamed: the listing was known, one of its
    codes led to it or was merged into it, and the authoritative name differs. fills_image: the known listing had none.
    result: ``product_created``, ``sp_created``, ``inserted`` or, where no store got a new price, ``skipped``.
    """
    c = F.col
    df = placed(offers, catalog, matches)
    of = lambda a: F.count_if(c("action") == a)
    coded = code_actions(df, codes, catalog).groupBy("offer_id").agg(*(of(a).alias(f"codes_{a}") for a in ("insert", "confirm", "merge", "move")))
    written = price_writes(df, latest, stores).groupBy("offer_id").agg(*(of(a).alias(f"stores_{a}") for a in ("insert", "extend", "keep")))
    listed = catalog.select(c("sp_id").alias("listed_id"), c("name").alias("listed_name"), F.coalesce("has_image", F.lit(False)).alias("listed_image"))
    df = df.join(coded, "offer_id", "left").join(written, "offer_id", "left").join(listed, c("sp_id") == c("listed_id"), "left")
    counts = [f"codes_{a}" for a in ("insert", "confirm", "merge", "move")] + [f"stores_{a}" for a in ("insert", "extend", "keep")]
    df = df.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in counts})
    known = c("sp_id").isNotNull()
    renamed = known & F.coalesce("name_authority", F.lit(False)) & (c("codes_confirm") + c("codes_merge") > 0) & (c("name") != c("listed_name"))
    fills = known & F.coalesce(c("has_image"), F.lit(False)) & ~c("listed_image")
    result = F.when(c("made") == "product", "product_created").when(c("made") == "sp", "sp_created").when(c("stores_insert") > 0, "inserted").otherwise("skipped")
    return df.select("offer_id", result.alias("result"), "via", "sp_id", "product_id", "category", "review", *counts, F.coalesce(renamed, F.lit(False)).alias("renamed"), F.coalesce(fills, F.lit(False)).alias("fills_image"))
