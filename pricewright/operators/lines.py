"""Receipt lines to store products, in stages of which each takes what the stages before have left open.

A line that comes with a product of its own chain keeps it unless size or form speak against it; one with a
product of another chain is led to its own chain's product of the same kind if price and size allow; all
others go by their exact name and size. Nothing is ever added to the catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineBars:
    """Thresholds of the resolver."""

    price_floor: float = 0.6  # of the other chain's latest price
    price_ceiling: float = 1.2
    amount_epsilon: float = 0.01
    size_mismatch: float = 0.3  # share of the larger size
    heal_confidence: float = 0.8


def has_fixed_form(amount: Column, unit: Column) -> Column:
    """True for a packed size: any unit but the kilogram alone; no unit is no pack."""
    u = F.lower(F.trim(unit))
    bulk = (u == "kg") & (amount.isNull() | (amount == 1))
    return F.coalesce((u != "") & ~bulk, F.lit(False))


def agrees(a: Column, b: Column) -> Column:
    """Equal, or unknown on one side."""
    return a.isNull() | b.isNull() | (a == b)


def same_size_in(asked: DataFrame, catalog: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each distinct (keys, amount, unit) of ``asked`` the first of ``catalog`` in ``order`` with its keys and no other size: found_id.

    Both sides are reduced to distinct sizes first, so that a name or product with many rows meets another only by its sizes.
    """
    sizes = catalog.groupBy(*keys, F.col("amount").alias("their_amount"), F.col("unit").alias("their_unit")).agg(F.min(F.struct(*order, F.col("sp_id"))).alias("first"))
    asked = asked.select(*keys, "amount", "unit").distinct()
    fits = agrees(F.col("amount"), F.col("their_amount")) & agrees(F.col("unit"), F.col("their_unit"))
    return asked.join(sizes, keys).where(fits).groupBy(*keys, "amount", "unit").agg(F.min("first")["sp_id"].alias("found_id"))


def with_found(lines: DataFrame, found: DataFrame, keys: list[str], to: str) -> DataFrame:
    """``lines`` with the found product as column ``to``; null sizes meet null sizes."""
    here = found.select(*(F.col(k).alias(f"f_{k}") for k in keys), F.col("amount").alias("f_amount"), F.col("unit").alias("f_unit"), F.col("found_id").alias(to))
    on = [F.col(k) == F.col(f"f_{k}") for k in keys] + [F.col("amount").eqNullSafe(F.col("f_amount")), F.col("unit").eqNullSafe(F.col("f_unit"))]
    return lines.join(here, on, "left").drop(*(f"f_{k}" for k in keys), "f_amount", "f_unit")


def resolved_lines(lines: DataFrame, catalog: DataFrame, latest: DataFrame, bars: LineBars = LineBars()) -> DataFrame:
    """line_id, sp_id, source, crossed, reject and heals for each line.

    ``lines``: line_id, chain_id, sp_id (the matcher's choice, or null), confidence, name, amount, unit, weighable, price.
    ``catalog``: sp_id, product_id, chain_id, name, amount, unit, weighable, has_image. ``latest``: sp_id, latest_price.

    source is ``reused`` (sp_id is set), ``unmatched``, ``skipped_unpriced`` (nothing found and no price above 0)
    or ``unnamed`` (nothing to go by). ``crossed`` says that the choice belonged to another chain, ``reject`` why it was refused;
    ``heals`` that the chosen product should become one sold by weight. Missing prices and sizes pass the gates.
    Several products that fit: those with an image first by name, else the smallest id. A choice that is not in
    the catalog counts as none. Repeated lines are resolved alike; null flags count as false.
    """
    c = F.col
    wanted = ["line_id", "chain_id", "sp_id", "confidence", "name", "amount", "unit", "price"]
    flag = lambda x: F.coalesce(x, F.lit(False))
    df = lines.select(*wanted, flag(c("weighable")).alias("weighable"), F.lower("name").alias("low_name"))
    chosen = catalog.select(
        c("sp_id").alias("own_id"), c("product_id"), c("chain_id").alias("own_chain"), c("amount").alias("own_amount"), c("unit").alias("own_unit"), flag(c("weighable")).alias("own_weighable")
    )
    df = df.join(chosen, c("sp_id") == c("own_id"), "left").join(latest.select(c("sp_id").alias("priced_id"), "latest_price"), c("own_id") == c("priced_id"), "left")
    same, other = flag(c("own_chain") == c("chain_id")), flag(c("own_chain") != c("chain_id"))

    off = F.abs(c("own_amount") - c("amount")) / F.greatest("own_amount", "amount")
    size_differs = flag((F.greatest("own_amount", "amount") > 0) & c("own_amount").isNotNull() & c("amount").isNotNull() & (off > bars.size_mismatch))
    form_differs = c("weighable") != c("own_weighable")
    heals = same & ~size_differs & c("weighable") & ~c("own_weighable") & ~has_fixed_form(c("own_amount"), c("own_unit")) & (F.coalesce("confidence", F.lit(0.0)) >= bars.heal_confidence)
    kept = same & ~size_differs & (~form_differs | heals)

    ratio = c("price") / F.when(c("latest_price") > 0, c("latest_price"))
    too_far = flag((c("price") > 0) & ((ratio < bars.price_floor) | (ratio > bars.price_ceiling)))
    both_sized = c("amount").isNotNull() & c("own_amount").isNotNull()
    unlike = both_sized & ((F.abs(c("amount") - c("own_amount")) >= bars.amount_epsilon) | ~c("unit").eqNullSafe(c("own_unit")))
    reject = F.when(other & too_far, "price_out_of_band").when(other & unlike, "amount_mismatch")
    df = df.withColumns({"kept": kept, "heals": heals, "other": other, "reject": reject})

    by_kind = same_size_in(df.where(c("other") & c("reject").isNull()), catalog, ["chain_id", "product_id"], [])
    df = with_found(df, by_kind, ["chain_id", "product_id"], "kind_id")
    listed = catalog.select("sp_id", "chain_id", F.lower("name").alias("low_name"), "amount", "unit", (~flag(c("has_image"))).alias("bare"))
    by_name = same_size_in(df.where(~c("kept") & ~c("other")), listed, ["chain_id", "low_name"], ["bare"])
    df = with_found(df, by_name, ["chain_id", "low_name"], "named_id")

    open_line = ~c("kept") & ~c("other")
    unnamed = open_line & (F.trim(F.coalesce("name", F.lit(""))) == "")
    found = F.when(c("kept"), c("sp_id")).when(c("other") & c("reject").isNull(), c("kind_id")).when(open_line & ~unnamed, c("named_id"))
    df = df.withColumn("found", found)
    source = F.when(c("found").isNotNull(), "reused").when(unnamed, "unnamed").when(flag(c("price") > 0), "unmatched").otherwise("skipped_unpriced")
    told = c("other") & c("reject").isNull() & (source != "skipped_unpriced")
    said = F.when(source == "unmatched", c("reject"))
    return df.select("line_id", c("found").alias("sp_id"), source.alias("source"), told.alias("crossed"), said.alias("reject"), "heals")
