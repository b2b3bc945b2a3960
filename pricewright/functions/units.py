"""Units, pack sizes and money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def family(unit: Column) -> Column:
    """'fluid' for kg, g, l, ml; 'count' for vnt, pak, rit; else null."""
    u = F.lower(unit)
    return F.when(u.isin("kg", "g", "l", "ml"), "fluid").when(u.isin("vnt", "pak", "rit"), "count")


def base_amount(amount: Column, unit: Column) -> Column:
    """Kilograms or litres for fluids, the amount itself for counts."""
    return F.when(F.lower(unit).isin("g", "ml"), amount / 1000).otherwise(amount)


def size_in_small_units(amount: Column, unit: Column) -> Column:
    """Grams or millilitres; null for anything else."""
    return F.when(unit.isin("kg", "l"), amount * 1000).when(unit.isin("g", "ml"), amount)


def dimension(unit: Column) -> Column:
    return F.when(unit.isin("kg", "g"), "mass").when(unit.isin("l", "ml"), "volume").when(unit.isin("vnt", "pak", "rit"), "piece")


def units_conflict(a: Column, b: Column) -> Column:
    """True if both units have a dimension and the dimensions differ."""
    return F.coalesce(dimension(a) != dimension(b), F.lit(False))


def same_unit(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def repaired_basis(amount: Column, unit: Column) -> Column:
    """Amount in kilograms or litres after repair of impossible sizes: above 100 means grams, below 0.001 kilograms."""
    base = base_amount(amount, unit)
    return F.when(dimension(unit) != "piece", F.when(base > 100, base / 1000).when(base < 0.001, base * 1000).otherwise(base)).otherwise(amount)


def rounded_quantity(q: Column, weighable: Column) -> Column:
    """Weighables in tenths within 0.1 to 20, others whole within 1 to 50."""
    return F.when(weighable, F.greatest(F.lit(0.1), F.least(F.lit(20.0), F.floor(q * 10 + 0.5) / 10))).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.floor(q + 0.5).cast("double"))))


def parse_size(text: Column) -> Column:
    """struct(amount, unit, weighable) read from a product name.

    In this order: ``a x b unit`` multiplies, a dual ``a unit / b unit`` takes the volume, then a simple
    ``a unit``, then a bare count. ``1 kg`` is sold by weight. Commas are decimal points.
    """
    t = F.regexp_replace(F.lower(text), ",", ".")
    num, unit = r"(\d+(?:\.\d+)?)", r"(kg|g|l|ml)\b"
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    multi, dual, simple, bare = rf"(\d+)\s*x\s*{num}\s*{unit}", rf"{num}\s*(?:kg|g)\s*/\s*{num}\s*(l|ml)\b", rf"{num}\s*{unit}", r"(\d+)\s*vnt\b"
    made = lambda amount, u: F.struct(amount.cast("double").alias("amount"), u.alias("unit"))
    size = (
        F.when(t.rlike(dual), made(part(dual, 2), part(dual, 3)))
        .when(t.rlike(multi), made(part(multi, 1).cast("double") * part(multi, 2).cast("double"), part(multi, 3)))
        .when(t.rlike(simple), made(part(simple, 1), part(simple, 2)))
        .when(t.rlike(bare), made(part(bare, 1), F.lit("vnt")))
    )
    return F.struct(size["amount"].alias("amount"), size["unit"].alias("unit"), F.coalesce((size["unit"] == "kg") & (size["amount"] == 1), F.lit(False)).alias("weighable"))
