"""Queries over baskets, packs and discounts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricewright.functions.units import base_amount, family, money, repaired_basis, size_in_small_units
from pricewright.operators import packed, pricing
from pricewright.operators import timeseries as ts
from pricewright.operators.dealing import dealt
from pricewright.operators.pricing import fine_mean
from pricewright.plans.registry import query
from pricewright.sources.domain import AS_OF, Domain

UNIT_SQL = """
fam AS (SELECT *, CASE WHEN unit IN ('kg','g','l','ml') THEN 'fluid' WHEN unit IN ('vnt','pak','rit') THEN 'count' END AS family,
  CASE WHEN unit IN ('g','ml') THEN amount / 1000 ELSE amount END AS base FROM sp),
g AS (SELECT product_id, count(*) FILTER (family = 'fluid') AS n_fluid, count(*) FILTER (family = 'count') AS n_count,
  count(*) FILTER (unit IN ('l','ml')) AS n_l, count(*) FILTER (unit IN ('kg','g')) AS n_kg,
  min(base) FILTER (family = 'fluid' AND amount > 0) AS least_fluid, count(DISTINCT floor(base * 1000 + 0.5)) FILTER (family = 'fluid' AND amount > 0) AS sizes,
  coalesce(bool_or(family = 'fluid' AND weighable), false) AS by_weight,
  count(*) FILTER (unit = 'vnt') AS n_vnt, count(*) FILTER (unit = 'pak') AS n_pak, count(*) FILTER (unit = 'rit') AS n_rit,
  min(amount) FILTER (unit = 'vnt' AND amount > 0) AS l_vnt, min(amount) FILTER (unit = 'pak' AND amount > 0) AS l_pak, min(amount) FILTER (unit = 'rit' AND amount > 0) AS l_rit
  FROM fam GROUP BY product_id),
u AS (SELECT *, n_fluid >= n_count AS fluid, CASE WHEN n_vnt >= n_pak AND n_vnt >= n_rit THEN 'vnt' WHEN n_pak >= n_rit THEN 'pak' ELSE 'rit' END AS cu FROM g WHERE n_fluid + n_count > 0),
c AS (SELECT product_id,
  CASE WHEN fluid AND NOT (NOT by_weight AND sizes <= 1) THEN 'fluid' ELSE 'count' END AS family,
  CASE WHEN fluid AND NOT by_weight AND sizes <= 1 THEN 'vnt' WHEN fluid THEN CASE WHEN n_l > n_kg THEN 'l' ELSE 'kg' END ELSE cu END AS unit,
  CASE WHEN fluid AND NOT by_weight AND sizes <= 1 THEN 1 WHEN fluid THEN CASE WHEN by_weight THEN least(coalesce(least_fluid, 1), 0.1) WHEN sizes > 1 THEN greatest(coalesce(least_fluid, 1), 0.5) ELSE coalesce(least_fluid, 1) END
    ELSE coalesce(CASE cu WHEN 'vnt' THEN l_vnt WHEN 'pak' THEN l_pak ELSE l_rit END, 1) END AS step FROM u)"""

LATEST_SQL = f"""
latest AS (SELECT sp_id, store_id, coalesce(CASE WHEN valid_from <= TIMESTAMP '{AS_OF}' AND promo_end > TIMESTAMP '{AS_OF}' THEN promo_price END, price) AS eff
  FROM price QUALIFY row_number() OVER (PARTITION BY sp_id, store_id ORDER BY id DESC, day DESC, price DESC, promo_price DESC NULLS LAST) = 1)"""


def mean_money(price: str):
    """Mean of prices, summed in whole cents so that no order of summing matters, to the cent."""
    return F.floor(F.sum(F.round(F.col(price) * 100).cast("long")) / F.count("*") + 0.5) / 100


def latest_eff(d: Domain):
    return ts.latest_per_store(d.price, AS_OF).select("sp_id", "store_id", F.coalesce("promo_price", "price").alias("eff"))


@query("uni04_canonical_units", UNIT_SQL + " SELECT product_id, family, unit, CAST(step AS DOUBLE) AS step FROM c")
def uni04(d: Domain):
    return pricing.canonical_units(d.sp)


@query("uni05_canonical_amounts", UNIT_SQL + """
SELECT s.sp_id, CAST(CASE WHEN c.family = 'count' AND c.unit = 'vnt' AND s.family = 'fluid' THEN 1 WHEN s.family <> c.family THEN NULL WHEN c.family = 'fluid' THEN s.base WHEN s.unit = c.unit THEN s.amount END AS DOUBLE) AS canonical
FROM fam s JOIN c USING (product_id)""")
def uni05(d: Domain):
    meta = pricing.canonical_units(d.sp).select("product_id", F.col("family").alias("to_family"), F.col("unit").alias("to_unit"))
    return d.sp.join(meta, "product_id").select("sp_id", pricing.canonical_amount(F.col("amount"), F.col("unit"), F.col("to_family"), F.col("to_unit")).alias("canonical"))


@query("uni03_unit_families", "SELECT CASE WHEN unit IN ('kg','g','l','ml') THEN 'fluid' ELSE 'count' END AS family, unit, count(*) AS n, round(sum(CASE WHEN unit IN ('g','ml') THEN amount / 1000 ELSE amount END), 6) AS base FROM sp GROUP BY ALL")
def uni03(d: Domain):
    return d.sp.groupBy(family(F.col("unit")).alias("family"), "unit").agg(F.count("*").alias("n"), F.round(F.sum(base_amount(F.col("amount"), F.col("unit"))), 6).alias("base"))


@query("uni06_unit_conflicts", """
dim AS (SELECT product_id, CASE WHEN unit IN ('kg','g') THEN 'mass' WHEN unit IN ('l','ml') THEN 'volume' ELSE 'piece' END AS dimension FROM sp)
SELECT product_id, count(DISTINCT dimension) AS dimensions FROM dim GROUP BY product_id HAVING count(DISTINCT dimension) > 1""")
def uni06(d: Domain):
    from pricewright.functions.units import dimension

    return d.sp.groupBy("product_id").agg(F.countDistinct(dimension(F.col("unit"))).alias("dimensions")).where("dimensions > 1")


@query("uni08_repaired_basis", """
SELECT sp_id, CASE WHEN unit IN ('vnt','pak') THEN amount WHEN b > 100 THEN b / 1000 WHEN b < 0.001 THEN b * 1000 ELSE b END AS basis
FROM (SELECT *, CASE WHEN unit IN ('g','ml') THEN amount / 1000 ELSE amount END AS b FROM sp)""")
def uni08(d: Domain):
    return d.sp.select("sp_id", repaired_basis(F.col("amount"), F.col("unit")).alias("basis"))


@query("flt11_sizes_and_labels", """
SELECT product_id, sum(CASE WHEN unit IN ('kg','l') THEN amount * 1000 WHEN unit IN ('g','ml') THEN amount END) AS small_units,
  CASE WHEN sum(CASE WHEN unit IN ('l','ml') THEN 1 ELSE 0 END) > sum(CASE WHEN unit IN ('kg','g') THEN 1 ELSE 0 END) THEN 'ml' ELSE 'g' END AS label FROM sp GROUP BY product_id""")
def flt11(d: Domain):
    liquid, solid = F.sum(F.when(F.col("unit").isin("l", "ml"), 1).otherwise(0)), F.sum(F.when(F.col("unit").isin("kg", "g"), 1).otherwise(0))
    return d.sp.groupBy("product_id").agg(F.sum(size_in_small_units(F.col("amount"), F.col("unit"))).alias("small_units"), F.when(liquid > solid, "ml").otherwise("g").alias("label"))


@query("mth03_rounded_quantities", """
SELECT sp_id, CASE WHEN weighable THEN greatest(0.1, least(20.0, floor(amount / 7 * 10 + 0.5) / 10)) ELSE greatest(1.0, least(50.0, floor(amount / 7 + 0.5))) END::DOUBLE AS quantity FROM sp""")
def mth03(d: Domain):
    from pricewright.functions.units import rounded_quantity

    return d.sp.select("sp_id", rounded_quantity(F.col("amount") / 7, F.col("weighable")).alias("quantity"))


#: The basket that is priced: what the newest receipt holds.
ITEMS_SQL = "items AS (SELECT sp_id AS item_id, product_id, CAST(sum(quantity) AS DOUBLE) AS quantity FROM price JOIN sp USING (sp_id) WHERE receipt_id = (SELECT receipt_id FROM price ORDER BY day DESC, receipt_id DESC LIMIT 1) GROUP BY ALL)"
TOTAL_SQL = "round(CASE WHEN weighable THEN quantity * eff / amount ELSE greatest(1, ceil(quantity / amount)) * eff END, 6)"


def basket_items(d: Domain):
    newest = d.price.orderBy(F.desc("day"), F.desc("receipt_id")).limit(1).select("receipt_id")
    bought = d.price.join(newest, "receipt_id").groupBy("sp_id").agg(F.sum("quantity").cast("double").alias("quantity"))
    return bought.join(d.sp.select("sp_id", "product_id"), "sp_id").select(F.col("sp_id").alias("item_id"), "product_id", "quantity")


SUB_SQL = """
scored AS (SELECT i.item_id, s.sp_id, round(len(list_distinct(list_intersect(string_split(m.name, ' '), string_split(s.name, ' '))))::DOUBLE / len(list_distinct(string_split(m.name, ' '))), 6) AS score
  FROM items i JOIN sp m ON m.sp_id = i.item_id JOIN sp s ON s.category = m.category AND s.product_id <> m.product_id AND (s.unit IN ('vnt', 'pak')) = (m.unit IN ('vnt', 'pak'))),
sub AS (SELECT * FROM scored WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, sp_id) <= 8)"""


@query("opt04_substitutes", f"""
{ITEMS_SQL}, {SUB_SQL}
SELECT item_id, sp_id, score FROM sub""")
def opt04(d: Domain):
    return pricing.substitutes(basket_items(d), d.sp)


@query("opt02_cheapest_pack_per_store", f"""
{ITEMS_SQL}, {LATEST_SQL},
offers AS (SELECT i.item_id, l.store_id, s.sp_id, {TOTAL_SQL} AS total FROM items i JOIN sp s USING (product_id) JOIN latest l USING (sp_id))
SELECT item_id, store_id, sp_id, total FROM offers QUALIFY row_number() OVER (PARTITION BY item_id, store_id ORDER BY total, sp_id) = 1""")
def opt02(d: Domain):
    offers = basket_items(d).join(d.sp.select("sp_id", "product_id", "amount", "weighable"), "product_id").join(latest_eff(d), "sp_id")
    return pricing.cheapest_for(offers, ["item_id", "store_id"]).select("item_id", "store_id", "sp_id", "total")


@query("opt01_basket_over_stores", f"""
{ITEMS_SQL}, {LATEST_SQL}, {SUB_SQL},
tier3 AS (SELECT item_id, store_id, 3 AS tier, {TOTAL_SQL} AS total, sp_id FROM sub JOIN items USING (item_id) JOIN (SELECT sp_id, amount, weighable FROM sp) USING (sp_id) JOIN latest USING (sp_id)),
offers AS (SELECT i.item_id, l.store_id, s.sp_id, t.chain_id, {TOTAL_SQL} AS total FROM items i JOIN sp s USING (product_id) JOIN latest l USING (sp_id) JOIN store t USING (store_id)),
tier12 AS (SELECT item_id, store_id, CASE WHEN sp_id = item_id THEN 1 ELSE 2 END AS tier, total, sp_id FROM offers),
by_chain AS (SELECT item_id, chain_id, min(total) AS total FROM offers GROUP BY ALL),
tier4 AS (SELECT item_id, round(avg(total), 6) AS total FROM by_chain GROUP BY item_id),
cand AS (SELECT item_id, store_id, tier, total, sp_id FROM tier12 UNION ALL SELECT * FROM tier3 UNION ALL SELECT item_id, store_id, 4, total, NULL FROM tier4, store),
pick AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY item_id, store_id ORDER BY tier, total, sp_id) = 1)
SELECT store_id, (SELECT count(*) FROM items) - count(*) AS n_missing, count(*) FILTER (tier = 4) AS n_averaged, count(*) FILTER (tier = 3) AS n_substituted,
  sum(CAST(floor(total * 100 + 0.5) AS BIGINT)) / 100 AS total FROM pick GROUP BY store_id""")
def opt01(d: Domain):
    items = basket_items(d)
    offers = items.join(d.sp.select("sp_id", "product_id", "amount", "weighable"), "product_id").join(latest_eff(d), "sp_id").join(d.store.select("store_id", "chain_id"), "store_id")
    offers = offers.withColumn("total", F.round(pricing.total_for(F.col("quantity"), F.col("eff"), F.col("amount"), F.col("weighable")), 6))
    direct = offers.select("item_id", "store_id", F.when(F.col("sp_id") == F.col("item_id"), 1).otherwise(2).alias("tier"), "total", "sp_id")
    average = offers.groupBy("item_id", "chain_id").agg(F.min("total").alias("total")).groupBy("item_id").agg(F.round(F.avg("total"), 6).alias("total"))
    # One basket's items beside every store: the basket is a bounded list.
    anywhere = d.store.select("store_id").crossJoin(average).select("item_id", "store_id", F.lit(4).alias("tier"), "total", F.lit(None).cast("long").alias("sp_id"))
    instead = pricing.substitutes(items, d.sp).join(items, "item_id").join(d.sp.select("sp_id", "amount", "weighable"), "sp_id").join(latest_eff(d), "sp_id")
    instead = instead.select("item_id", "store_id", F.lit(3).alias("tier"), F.round(pricing.total_for(F.col("quantity"), F.col("eff"), F.col("amount"), F.col("weighable")), 6).alias("total"), "sp_id")
    pick = direct.unionByName(instead).unionByName(anywhere).groupBy("item_id", "store_id").agg(F.min(F.struct("tier", "total", "sp_id")).alias("best")).select("store_id", "best.tier", "best.total")
    wanted = items.agg(F.count("*").alias("wanted"))
    totals = pricing.store_totals(pick, 0).crossJoin(wanted)
    return totals.select("store_id", (F.col("wanted") + F.col("n_missing")).alias("n_missing"), "n_averaged", "n_substituted", "total").orderBy("n_missing", "n_averaged", "n_substituted", "total", "store_id")


@query("opt05_average_by_pack_bucket", f"""
{LATEST_SQL}, {UNIT_SQL},
canon AS (SELECT s.sp_id, s.product_id, s.weighable, round(CASE WHEN c.family = 'count' AND c.unit = 'vnt' AND s.family = 'fluid' THEN 1 WHEN s.family <> c.family THEN NULL WHEN c.family = 'fluid' THEN s.base WHEN s.unit = c.unit THEN s.amount END, 3) AS size FROM fam s JOIN c USING (product_id)),
per_store AS (SELECT product_id, weighable, size, store_id, min(eff) AS eff FROM canon JOIN latest USING (sp_id) WHERE size IS NOT NULL GROUP BY ALL),
bucket AS (SELECT product_id, weighable, size, count(*) AS stores, floor(sum(CAST(round(eff * 100) AS BIGINT)) / count(*) + 0.5) / 100 AS mean FROM per_store GROUP BY ALL)
SELECT product_id, size, stores, mean FROM bucket QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY stores DESC, size, weighable) = 1""")
def opt05(d: Domain):
    meta = pricing.canonical_units(d.sp).select("product_id", F.col("family").alias("to_family"), F.col("unit").alias("to_unit"))
    canon = d.sp.join(meta, "product_id").select("sp_id", "product_id", "weighable", F.round(pricing.canonical_amount(F.col("amount"), F.col("unit"), F.col("to_family"), F.col("to_unit")), 3).alias("size")).where("size is not null")
    per_store = canon.join(latest_eff(d), "sp_id").groupBy("product_id", "weighable", "size", "store_id").agg(F.min("eff").alias("eff"))
    bucket = per_store.groupBy("product_id", "weighable", "size").agg(F.count("*").alias("stores"), mean_money("eff").alias("mean"))
    best = bucket.groupBy("product_id").agg(F.min(F.struct((-F.col("stores")).alias("fewest"), "size", "weighable", "stores", "mean")).alias("b"))
    return best.select("product_id", "b.size", "b.stores", "b.mean")


@query("opt07_split_basket", f"""
{ITEMS_SQL}, {LATEST_SQL},
offers AS (SELECT i.item_id, l.store_id, min({TOTAL_SQL}) AS total FROM items i JOIN sp s USING (product_id) JOIN latest l USING (sp_id) GROUP BY ALL),
pairs AS (SELECT DISTINCT a.store_id AS a, b.store_id AS b FROM offers a JOIN offers b ON a.store_id < b.store_id),
best AS (SELECT p.a, p.b, o.item_id, min(o.total) AS total FROM pairs p JOIN offers o ON o.store_id IN (p.a, p.b) GROUP BY ALL)
SELECT a, b, count(*) AS covered, sum(CAST(round(total * 1000000) AS BIGINT)) / 1000000 AS total FROM best GROUP BY a, b""")
def opt07(d: Domain):
    offers = basket_items(d).join(d.sp.select("sp_id", "product_id", "amount", "weighable"), "product_id").join(latest_eff(d), "sp_id")
    offers = pricing.cheapest_for(offers, ["item_id", "store_id"]).select("item_id", "store_id", "total")
    stores = offers.select("store_id").distinct()
    pairs = stores.select(F.col("store_id").alias("a")).join(stores.select(F.col("store_id").alias("b")), F.col("a") < F.col("b"))
    either = pairs.withColumn("store_id", F.explode(F.array("a", "b"))).join(offers, "store_id")
    best = either.groupBy("a", "b", "item_id").agg(F.min("total").alias("total"))
    return best.groupBy("a", "b").agg(F.count("*").alias("covered"), (F.sum(F.round(F.col("total") * 1000000).cast("long")) / 1000000).alias("total"))


REAL_SQL = f"""
{LATEST_SQL},
unit AS (SELECT sp.product_id, s.chain_id, round(l.eff / CASE WHEN sp.unit IN ('vnt','pak') THEN amount WHEN b > 100 THEN b / 1000 WHEN b < 0.001 THEN b * 1000 ELSE b END, 6) AS unit_price
  FROM (SELECT *, CASE WHEN unit IN ('g','ml') THEN amount / 1000 ELSE amount END AS b FROM sp) sp JOIN latest l USING (sp_id) JOIN store s USING (store_id) WHERE amount > 0 AND unit IN ('kg','g')),
by_chain AS (SELECT product_id, chain_id, min(unit_price) AS unit_price FROM unit GROUP BY ALL),
g AS (SELECT product_id, min(unit_price) AS least, max(unit_price) AS most, round(avg(unit_price), 6) AS mean, count(*) AS chains FROM by_chain GROUP BY product_id)"""


def unit_offers(d: Domain):
    solid = d.sp.where("amount > 0").where(F.col("unit").isin("kg", "g")).select("sp_id", "product_id", repaired_basis(F.col("amount"), F.col("unit")).alias("basis"))
    return solid.join(latest_eff(d), "sp_id").join(d.store.select("store_id", "chain_id"), "store_id").select("product_id", "chain_id", F.round(F.col("eff") / F.col("basis"), 6).alias("unit_price"))


@query("opt12_real_discount", REAL_SQL + """
SELECT product_id, chains, floor(least * 100 + 0.5) / 100 AS least, CAST(floor((mean - least) / mean * 100 + 0.5) AS INT) AS percent FROM g WHERE chains >= 2 AND most <= 5 * least""")
def opt12(d: Domain):
    return pricing.real_discount(unit_offers(d))


@query("opt13_discount_summary", """
SELECT sp.product_id, max(CAST(floor((p.price - p.promo_price) / p.price * 100 + 0.5) AS INT)) AS percent, count(DISTINCT p.store_id) AS stores
FROM price p JOIN sp USING (sp_id) WHERE p.promo_price > 0 AND p.promo_price < p.price GROUP BY sp.product_id HAVING max(floor((p.price - p.promo_price) / p.price * 100 + 0.5)) > 0""")
def opt13(d: Domain):
    deals = d.price.where("promo_price > 0 and promo_price < price").join(d.sp.select("sp_id", "product_id"), "sp_id")
    percent = F.floor((F.col("price") - F.col("promo_price")) / F.col("price") * 100 + 0.5).cast("int")
    return deals.groupBy("product_id").agg(F.max(percent).alias("percent"), F.countDistinct("store_id").alias("stores")).where("percent > 0")


@query("opt14_unit_price_badge", f"""
last AS (SELECT sp_id, CASE WHEN promo_price IS NOT NULL AND (promo_end IS NULL OR promo_end >= TIMESTAMP '{AS_OF}') THEN promo_price ELSE price END AS eff FROM price
  QUALIFY row_number() OVER (PARTITION BY sp_id ORDER BY id DESC, day DESC, price DESC, promo_price DESC NULLS LAST) = 1),
rate AS (SELECT product_id, CASE WHEN unit IN ('kg','g') THEN 'kg' WHEN unit IN ('l','ml') THEN 'l' ELSE 'piece' END AS basis, min(eff / CASE WHEN unit IN ('g','ml') THEN amount / 1000 ELSE amount END) AS rate FROM sp JOIN last USING (sp_id) WHERE amount > 0 AND eff > 0 GROUP BY ALL),
g AS (SELECT product_id, min(rate) FILTER (basis = 'kg') AS kg, min(rate) FILTER (basis = 'l') AS l, min(rate) FILTER (basis = 'piece') AS piece FROM rate GROUP BY product_id)
SELECT product_id, CASE WHEN kg IS NOT NULL AND l IS NOT NULL THEN NULL WHEN kg IS NOT NULL THEN 'kg' WHEN l IS NOT NULL THEN 'l' ELSE 'piece' END AS basis,
  CASE WHEN kg IS NOT NULL AND l IS NOT NULL THEN NULL ELSE floor(coalesce(kg, l, piece) * 10000 + 0.5) / 10000 END AS rate FROM g""")
def opt14(d: Domain):
    last = ts.latest_by(d.price, ["sp_id"], ts.TIES)
    running = F.col("promo_price").isNotNull() & F.coalesce(F.col("promo_end") >= F.lit(AS_OF).cast("timestamp_ntz"), F.lit(True))
    eff = last.select("sp_id", F.when(running, F.col("promo_price")).otherwise(F.col("price")).alias("eff"))
    rate = F.col("eff") / base_amount(F.col("amount"), F.col("unit"))
    of = lambda *units: F.min(F.when(F.col("unit").isin(*units), rate))
    g = d.sp.where("amount > 0").join(eff.where("eff > 0"), "sp_id").groupBy("product_id").agg(of("kg", "g").alias("kg"), of("l", "ml").alias("l"), of("vnt", "pak").alias("piece"))
    both = F.col("kg").isNotNull() & F.col("l").isNotNull()
    basis = F.when(both, None).when(F.col("kg").isNotNull(), "kg").when(F.col("l").isNotNull(), "l").otherwise("piece")
    return g.select("product_id", basis.alias("basis"), F.when(~both, F.floor(F.coalesce("kg", "l", "piece") * 10000 + 0.5) / 10000).alias("rate"))


@query("opt15_savings_against_market", """
last AS (SELECT sp_id, price FROM price WHERE NOT is_fallback QUALIFY rank() OVER (PARTITION BY sp_id ORDER BY day DESC) = 1),
market AS (SELECT product_id, floor(sum(CAST(round(price * 100) AS BIGINT)) * 100 / count(*)::DOUBLE + 0.5) / 10000 AS mean FROM last JOIN sp USING (sp_id) GROUP BY product_id)
SELECT p.receipt_id, sum((CAST(round(m.mean * 10000) AS BIGINT) - CAST(round(p.price * 100) AS BIGINT) * 100) * CAST(p.quantity AS BIGINT)) / 10000 AS savings FROM price p JOIN sp USING (sp_id) JOIN market m USING (product_id) GROUP BY p.receipt_id""")
def opt15(d: Domain):
    offers = dealt(d.price.where("not is_fallback").select("sp_id", "day", "price"), d.n_lines, "sp_id")
    last = offers.withColumn("last", F.max("day").over(Window.partitionBy("sp_id"))).where("day = last")
    named = d.sp.select("sp_id", "product_id")
    market = last.join(named, "sp_id").groupBy("product_id").agg(fine_mean("price").alias("mean"))
    # Lines meet the market once, by product, and go on as one number each.
    means = named.join(market, "product_id").select("sp_id", "mean")
    lines = dealt(d.price.select("receipt_id", "sp_id", "price", "quantity"), d.n_lines, "sp_id").join(means, "sp_id")
    less = (F.round(F.col("mean") * 10000).cast("long") - F.round(F.col("price") * 100).cast("long") * 100) * F.col("quantity").cast("long")
    return dealt(lines.select("receipt_id", less.alias("less")), d.n_lines, "receipt_id").groupBy("receipt_id").agg((F.sum("less") / 10000).alias("savings"))


@query("opt08_receipt_comparison", f"""
{LATEST_SQL},
line AS (SELECT receipt_id, sp_id, sum(quantity) AS quantity, max(price) AS paid FROM price GROUP BY ALL),
chain_offer AS (SELECT sp_id, chain_id, min(eff) AS eff FROM latest JOIN store USING (store_id) GROUP BY ALL),
mean AS (SELECT sp_id, floor(sum(CAST(round(eff * 100) AS BIGINT)) / count(*) + 0.5) / 100 AS eff FROM chain_offer GROUP BY sp_id),
chains AS (SELECT DISTINCT l.receipt_id, o.chain_id FROM line l JOIN chain_offer o USING (sp_id)),
cell AS (SELECT c.receipt_id, c.chain_id, l.sp_id, l.quantity, coalesce(o.eff, m.eff, l.paid) AS eff, CASE WHEN o.eff IS NOT NULL THEN 1 ELSE 0 END AS known
  FROM chains c JOIN line l USING (receipt_id) LEFT JOIN chain_offer o ON o.sp_id = l.sp_id AND o.chain_id = c.chain_id LEFT JOIN mean m ON m.sp_id = l.sp_id)
SELECT receipt_id, chain_id, sum(known)::BIGINT AS known, count(*) AS lines, sum(CAST(round(eff * 100) AS BIGINT) * CAST(quantity AS BIGINT)) / 100 AS total FROM cell GROUP BY ALL""")
def opt08(d: Domain):
    """What a receipt would cost in each chain that has any of it; what the chain lacks costs its mean, or what was paid.

    A receipt's total at those fallbacks is the same in all chains, so a chain adds only the differences of the lines it
    offers. Offers and lines are dealt by product once each; a product's offers then travel with its lines as a few packed longs,
    so no line meets every chain of its receipt and what is shuffled stays near what the offers hold.
    """
    c = F.col
    cents = lambda x: F.round(c(x) * 100).cast("long").alias(x)
    priced = d.price.select("sp_id", "store_id", "id", "day", cents("price"), cents("promo_price"), ts.promo_active(AS_OF, open_end=False).alias("active"))
    latest = ts.latest_by(dealt(priced, d.n_lines, "sp_id"), ["sp_id", "store_id"], [*ts.TIES, "active"])
    latest = latest.select("sp_id", "store_id", F.when(c("active"), c("promo_price")).otherwise(c("price")).alias("eff"))
    offer = latest.join(d.store.select("store_id", "chain_id"), "store_id").groupBy("sp_id", "chain_id").agg(F.min("eff").alias("eff"))
    mean = F.floor(F.sum("eff") / F.count("*") + 0.5).alias("mean")
    offers = offer.groupBy("sp_id").agg(F.collect_list(F.struct("chain_id", "eff")).alias("o"), mean, F.min("eff").alias("least"), F.max("eff").alias("most"), F.min("chain_id").alias("first"), F.max("chain_id").alias("last"))
    # Numbers count from the least, which is 1; 0 is null. ``head`` holds how many offers there are and how wide their numbers.
    offers = offers.withColumns({"e_bits": packed.bits(F.coalesce(c("most") - c("least") + 1, F.lit(1))), "c_bits": packed.bits(F.coalesce(c("last").cast("long") - c("first") + 1, F.lit(1)))})
    above = lambda x, least: F.coalesce(x.cast("long") - c(least) + 1, F.lit(0).cast("long"))
    codes = F.concat(packed.packed(F.transform("o.eff", lambda x: above(x, "least")), c("e_bits")), packed.packed(F.transform("o.chain_id", lambda x: above(x, "first")), c("c_bits")))
    offers = offers.select("sp_id", "mean", "least", "first", (F.size("o") * 4096 + c("e_bits") * 64 + c("c_bits")).alias("head"), codes.alias("codes"))
    line = dealt(d.price.select("receipt_id", "sp_id", "quantity", cents("price")), d.n_lines, "sp_id").groupBy("receipt_id", "sp_id").agg(F.sum("quantity").cast("long").alias("quantity"), F.max("price").alias("paid"))
    line = line.join(offers, "sp_id", "left").select("receipt_id", "quantity", (F.coalesce("mean", "paid") * c("quantity")).alias("fallback"), "head", "least", "first", "codes")
    # A receipt has a row for each chain in the end, so its tasks are smaller.
    line = dealt(line, 4 * d.n_lines, "receipt_id")
    own = Window.partitionBy("receipt_id")
    line = line.withColumns({"n_lines": F.count("*").over(own), "base": F.sum("fallback").over(own)})
    n, e_bits, c_bits = (F.shiftright("head", 12), F.shiftright("head", 6).bitwiseAND(63), c("head").bitwiseAND(63))
    each = line.where("head IS NOT NULL").select("*", n.alias("n"), e_bits.alias("e_bits"), c_bits.alias("c_bits"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    real = lambda code, least: F.when(code > 0, code - 1 + c(least))
    eff = real(packed.unpacked(c("codes"), F.lit(0), c("i"), c("e_bits")), "least")
    chain = real(packed.unpacked(c("codes"), packed.longs(c("n"), c("e_bits")), c("i"), c("c_bits")), "first").cast(d.store.schema["chain_id"].dataType)
    # An unknown chain has no known price.
    each = each.select("receipt_id", "n_lines", "base", "quantity", "fallback", chain.alias("chain_id"), F.when(chain.isNotNull(), eff).alias("eff"))
    more = c("eff") * c("quantity") - F.coalesce("fallback", F.lit(0))
    found = each.groupBy("receipt_id", "chain_id").agg(F.count("eff").alias("known"), F.max("n_lines").alias("lines"), F.max("base").alias("base"), F.sum(more).alias("more"))
    total = F.when(c("base").isNotNull() | c("more").isNotNull(), F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0)))
    return found.select("receipt_id", "chain_id", "known", "lines", (total / 100).alias("total"))


@query("opt09_comparison_snapshot", """
per_store AS (SELECT sp_id, store_id, min(price) AS price FROM price GROUP BY ALL)
SELECT sp_id, median(price) AS median_price, min(price) AS cheapest, count(*) AS stores FROM per_store GROUP BY sp_id""")
def opt09(d: Domain):
    per_store = d.price.groupBy("sp_id", "store_id").agg(F.min("price").alias("price"))
    return per_store.groupBy("sp_id").agg(F.median("price").alias("median_price"), F.min("price").alias("cheapest"), F.count("*").alias("stores"))


@query("opt11_chain_ranking", """
total AS (SELECT chain_id, floor(sum(CAST(round(price * 100) AS BIGINT)) * 100 / count(*)::DOUBLE + 0.5) / 10000 AS mean FROM price JOIN store USING (store_id) GROUP BY chain_id),
r AS (SELECT *, row_number() OVER (ORDER BY mean, chain_id) AS rn, count(*) OVER () AS n FROM total)
SELECT CASE WHEN rn = 1 THEN 'cheapest' WHEN rn = n THEN 'dearest' ELSE 'runner_up' END AS place, chain_id, mean FROM r WHERE rn IN (1, 2) OR rn = n""")
def opt11(d: Domain):
    total = d.price.join(d.store.select("store_id", "chain_id"), "store_id").groupBy("chain_id").agg(fine_mean("price").alias("mean"))
    # One row per chain.
    order = Window.orderBy("mean", "chain_id")
    r = total.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy()))
    return r.where("rn in (1, 2) or rn = n").select(F.when(F.col("rn") == 1, "cheapest").when(F.col("rn") == F.col("n"), "dearest").otherwise("runner_up").alias("place"), "chain_id", "mean")
