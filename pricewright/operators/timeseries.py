"""Prices over time: the different meanings of latest, active and as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions.units import money

#: What orders observations with one id: source rows may repeat.
TIES = ["id", "day", "price", "promo_price"]


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in ``order`` (nulls least).

    One aggregate with a partial maximum per task instead of a sorted window, so a key that holds a
    third of all rows costs one row per task. Rows that tie in all of ``order`` agree in what matters.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy(*keys).agg(F.max(packed).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def promo_active(as_of: str, open_end: bool, check_start: bool = True) -> Column:
    """Whether a promotion runs at ``as_of``; ``open_end`` says what a missing end means."""
    now = F.lit(as_of).cast("timestamp_ntz")
    started = (F.col("valid_from").isNull() | (F.col("valid_from") <= now)) if check_start else F.lit(True)
    return F.col("promo_price").isNotNull() & started & F.coalesce(F.col("promo_end") > now, F.lit(open_end))


def latest_per_store(price: DataFrame, as_of: str) -> DataFrame:
    """Latest by id per (sp, store); a promotion that doesn't run is nulled, one without end doesn't run."""
    last = latest_by(price, ["sp_id", "store_id"], TIES)
    return last.withColumn("promo_price", F.when(promo_active(as_of, open_end=False), F.col("promo_price")))


def effective(price: DataFrame) -> Column:
    return F.coalesce(F.col("promo_price"), F.col("price"))


def baseline(price: DataFrame, n: int = 5) -> DataFrame:
    """Mean of the last ``n`` verified prices that are no fallbacks, per (sp, store); null for fewer than two."""
    order = Window.partitionBy("sp_id", "store_id").orderBy(F.desc("day"), F.desc("id"), F.desc("price"))
    last = price.where("verified and not is_fallback").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    sums = last.groupBy("sp_id", "store_id").agg(F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    return sums.select("sp_id", "store_id", F.when(F.col("n") >= 2, money(F.col("cents") / F.col("n") / 100)).alias("baseline"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[Column]) -> DataFrame:
    """For each row of ``left`` the first of ``right`` in ``order`` with the same keys and ``day`` not after ``at``.

    ``left`` needs a unique ``left_id``. The join is on the keys alone and the pick a partial maximum.
    """
    pairs = left.join(right, keys).where(F.col("day") <= F.col(at))
    return pairs.groupBy("left_id").agg(F.max_by(F.struct(*right.columns), F.struct(*order)).alias("found"))


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, condition: Column, also: Column | None = None) -> DataFrame:
    """Pairs whose values differ by at most ``width``: an equi-join on buckets of that width and their neighbours.

    ``also`` is a further equality between the sides that the join can use.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    near = left.withColumn("_b", F.explode(F.array(bucket(left_value) - 1, bucket(left_value), bucket(left_value) + 1)))
    far = right.withColumn("_c", bucket(right_value))
    on = F.col("_b") == F.col("_c")
    return near.join(far, on if also is None else on & also).drop("_c").where((F.abs(F.col(left_value) - F.col(right_value)) <= width) & condition).drop("_b")
