"""For every line the products with the nearest prices within some days, by stretches of prices and days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.operators.dealing import dealt

#: Prices and days of a stretch: wide enough for its edges, which lines are copied for, to be a small part of it.
STRETCH_PRICE, STRETCH_DAYS = 8, 360
#: Pairs that a task compares at a time, and rows that it hands on at a time.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 200_000
#: Stand in for an unknown product (which goes last) and an unknown line.
NO_PRODUCT, NO_LINE = 2**63 - 1, -(2**63)

SCHEMA = "line_id bigint, paid double, sp_id bigint, distance double"


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    first = np.ones(len(columns[0]), dtype=bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows, sorted by the first column, then by the second and so on."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    first = _firsts(*columns)
    return tuple(c[first] for c in columns)


def _places(first: np.ndarray) -> np.ndarray:
    """Each row's place in its group, from 0; ``first`` tells where groups begin."""
    starts = np.flatnonzero(first)
    return np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first))))


def least_offers(price: np.ndarray, day: np.ndarray, sp: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each price and day the products with the least ids: nobody's nearest can be others."""
    price, day, sp = _distinct(price, day, sp)
    kept = _places(_firsts(price, day)) < most
    return price[kept], day[kept], sp[kept]


class Offers:
    """Offers in buckets of days, each sorted by price."""

    def __init__(self, price: np.ndarray, day: np.ndarray, sp: np.ndarray, days: int):
        self.days, self.prices = days, np.unique(price)
        bucket = day // max(days, 1)
        self.least, self.buckets = bucket.min(initial=0), bucket.max(initial=0) - bucket.min(initial=0) + 1
        key = (bucket - self.least) * len(self.prices) + np.searchsorted(self.prices, price)
        order = np.argsort(key, kind="stable")
        self.key, self.price, self.day, self.sp = key[order], price[order], day[order], sp[order]

    def ranges(self, price: np.ndarray, day: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Where offers within ``reach`` lie: three ranges for each of the asked, one after another."""
        n = len(self.prices)
        low, high = np.searchsorted(self.prices, price - reach), np.searchsorted(self.prices, price + reach, side="right")
        begins, ends = [], []
        for step in (-1, 0, 1):
            bucket = day // max(self.days, 1) - self.least + step
            known = (bucket >= 0) & (bucket < self.buckets)
            begin, end = np.searchsorted(self.key, bucket * n + low), np.searchsorted(self.key, bucket * n + high)
            begins.append(begin)
            ends.append(np.where(known, end, begin))
        return np.stack(begins, 1).ravel(), np.stack(ends, 1).ravel()


def nearest(offers: Offers, price: np.ndarray, day: np.ndarray, width: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, product, cents): of each asked price and day the ``most`` nearest products, by cents and then by id.

    Bands of prices grow until they hold enough products, so where offers lie close few are looked at.
    """
    found = []
    active = np.arange(len(price))
    last = int(np.floor(width * 100 + 0.5))
    for cents in sorted({c for c in (0, 2, 8) if c < last} | {last}):
        left = []
        # A little more than the band is fetched; what counts is decided by the same sums as in SQL.
        begin, end = offers.ranges(price[active], day[active], (cents + 0.6) / 100)
        sizes = (end - begin).reshape(-1, 3).sum(axis=1)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS_AT_ONCE)) + 1
        for part in np.split(np.arange(len(active)), cuts):
            if not len(part):
                continue
            three = slice(3 * part[0], 3 * part[-1] + 3)
            size = end[three] - begin[three]
            total = int(size.sum())
            at = np.repeat(begin[three] - (np.cumsum(size) - size), size) + np.arange(total)
            who = np.repeat(np.repeat(active[part], 3), size)
            away = np.abs(price[who] - offers.price[at])
            near = (away <= width) & (np.abs(day[who] - offers.day[at]) <= offers.days)
            who, at, far = who[near], at[near], np.floor(away[near] * 100 + 0.5).astype(np.int64)
            inside = far <= cents
            who, sp, far = _distinct(who[inside], offers.sp[at[inside]], far[inside])
            once = _firsts(who, sp)
            who, far, sp = who[once], far[once], sp[once]
            order = np.lexsort((sp, far, who))
            who, far, sp = who[order], far[order], sp[order]
            kept = _places(_firsts(who)) < most
            who, far, sp = who[kept], far[kept], sp[kept]
            enough = np.bincount(who - active[part[0]], minlength=active[part[-1]] - active[part[0]] + 1)[active[part] - active[part[0]]] >= most
            if cents < last:
                left.append(active[part][~enough])
                full = np.isin(who, active[part][enough])
                who, far, sp = who[full], far[full], sp[full]
            found.append((who, sp, far))
        active = np.concatenate(left) if left else active[:0]
        if not len(active):
            break
    if not found:
        return (np.empty(0, np.int64),) * 3
    who, sp, far = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(who, kind="stable")
    return who[order], sp[order], far[order]


def nearest_products(price: DataFrame, n_lines: int, width: float, days: int, most: int) -> DataFrame:
    """line_id, paid, sp_id, distance: for each line of ``price`` the products at the nearest prices within ``days`` days.

    Each line is dealt out once, to its stretch of prices and days, and copied only to stretches that begin or end within
    its reach; a task holds about half a million lines and answers its own. What is shuffled so grows with the lines, however
    close their prices lie. Of each price and day only the ``most`` least products meet others; a task's lines are held in memory.
    """
    c = F.col
    stretch = lambda p, d: (F.floor(p / STRETCH_PRICE) * 10_000 + F.floor(F.unix_date(d) / STRETCH_DAYS)).cast("long")
    line = price.where("price IS NOT NULL AND day IS NOT NULL").select(F.coalesce(c("id").cast("long"), F.lit(NO_LINE)).alias("id"), F.coalesce(c("sp_id").cast("long"), F.lit(NO_PRODUCT)).alias("sp_id"), c("price").cast("double").alias("price"), "day")
    reach = width + 0.01
    places = F.array_distinct(F.array(*(stretch(c("price") + p, F.date_add("day", d)) for p in (0, -reach, reach) for d in (0, -days, days))))
    rows = dealt(line.select("*", F.explode(places).alias("place")), n_lines, "place")
    rows = rows.select("id", "sp_id", "price", F.unix_date("day").cast("long").alias("day"), (c("place") == stretch(c("price"), c("day"))).alias("own"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(5)] for b in batches]
        if not parts:
            return
        ids, sps, paid, day, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        offers = Offers(*least_offers(paid, day, sps, most), days)
        del sps
        paid, day, ids = _distinct(paid[own], day[own], ids[own])
        first = _firsts(paid, day)
        asked = np.cumsum(first) - 1
        who, sp, far = nearest(offers, paid[first], day[first], width, most)
        counts = np.bincount(who, minlength=int(first.sum()))
        starts = np.cumsum(counts) - counts
        step = max(1, ROWS_AT_ONCE // most)
        for at in range(0, len(ids), step):
            mine = asked[at : at + step]
            n = counts[mine]
            rows = np.repeat(np.arange(len(mine)), n)
            hit = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(len(rows))
            line_id, product = ids[at : at + step][rows], sp[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(line_id, mask=line_id == NO_LINE), pa.array(paid[at : at + step][rows]), pa.array(product, mask=product == NO_PRODUCT), pa.array(far[hit] / 100)], names=["line_id", "paid", "sp_id", "distance"]
            )

    return rows.mapInArrow(answer, SCHEMA)
