"""Queries of the staged resolvers: receipt lines and scraped offers against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.functions import names
from pricewright.operators import aggregated, confusions, files, lines, minting, rehoming, upserts
from pricewright.operators import timeseries as ts
from pricewright.plans.matching import NORMAL_SQL
from pricewright.plans.registry import query
from pricewright.plans.resolution import DECISION_SQL, NAMES_SQL, UNASSIGNED, asked_columns, catalog, chain_pairs_sql, confident_names, decisions, scored_products
from pricewright.sources.domain import Domain


def chain_catalog(d: Domain) -> DataFrame:
    """Each product with the chain that sold it first; a product with a verified price has an image."""
    sold = d.price.select("sp_id", "store_id", "day", "id", "verified").join(d.store.select("store_id", "chain_id"), "store_id")
    home = sold.groupBy("sp_id").agg(F.min(F.struct("day", "id", "chain_id"))["chain_id"].alias("chain_id"), F.bool_or("verified").alias("has_image"))
    return d.sp.select("sp_id", "product_id", "name", "amount", "unit", "weighable", "category").join(home, "sp_id")


CATALOG_SQL = """home AS (SELECT sp_id, arg_min(chain_id, (day, id, chain_id)) AS chain_id, bool_or(verified) AS has_image FROM price JOIN store USING (store_id) GROUP BY sp_id),
listed AS (SELECT sp.*, home.chain_id, home.has_image FROM sp JOIN home USING (sp_id))"""


@query("er10_resolved_lines", CATALOG_SQL + """,
newest AS (SELECT sp_id, arg_max(price, (day, id, price)) AS latest_price FROM price JOIN store USING (store_id) JOIN home USING (sp_id, chain_id) GROUP BY sp_id),
line AS (SELECT p.id, p.sp_id AS asked_id, p.store_id, s.chain_id, CASE WHEN NOT p.is_fallback THEN p.sp_id END AS sp_id, sp.name, CASE WHEN NOT sp.weighable THEN sp.amount END AS amount, CASE WHEN NOT sp.weighable THEN sp.unit END AS unit, p.price
  FROM price p JOIN store s USING (store_id) JOIN sp ON sp.sp_id = p.sp_id),
own AS (SELECT line.*, c.product_id, c.chain_id AS own_chain, c.amount AS own_amount, c.unit AS own_unit, latest_price FROM line LEFT JOIN listed c ON c.sp_id = line.sp_id LEFT JOIN newest n ON n.sp_id = c.sp_id),
gate AS (SELECT *, coalesce(own_chain = chain_id, false) AS kept, coalesce(own_chain <> chain_id, false) AS other,
  CASE WHEN own_chain <> chain_id AND price > 0 AND latest_price > 0 AND (price / latest_price < 0.6 OR price / latest_price > 1.2) THEN 'price_out_of_band' END AS reject FROM own),
kind AS (SELECT a.chain_id, a.product_id, a.amount, a.unit, min(c.sp_id) AS kind_id FROM (SELECT DISTINCT chain_id, product_id, amount, unit FROM gate WHERE other AND reject IS NULL) a
  JOIN listed c ON c.chain_id = a.chain_id AND c.product_id = a.product_id AND (a.amount IS NULL OR c.amount = a.amount) AND (a.unit IS NULL OR c.unit = a.unit) GROUP BY ALL),
named AS (SELECT a.chain_id, a.low_name, a.amount, a.unit, arg_min(c.sp_id, (NOT c.has_image, c.sp_id)) AS named_id FROM (SELECT DISTINCT chain_id, lower(name) AS low_name, amount, unit FROM gate WHERE NOT kept AND NOT other) a
  JOIN listed c ON c.chain_id = a.chain_id AND lower(c.name) = a.low_name AND (a.amount IS NULL OR c.amount = a.amount) AND (a.unit IS NULL OR c.unit = a.unit) GROUP BY ALL),
found AS (SELECT g.*, CASE WHEN kept THEN g.sp_id WHEN other AND reject IS NULL THEN kind_id WHEN NOT other THEN named_id END AS found_id FROM gate g
  LEFT JOIN kind k ON k.chain_id = g.chain_id AND k.product_id = g.product_id AND k.amount IS NOT DISTINCT FROM g.amount AND k.unit IS NOT DISTINCT FROM g.unit
  LEFT JOIN named n ON n.chain_id = g.chain_id AND n.low_name = lower(g.name) AND n.amount IS NOT DISTINCT FROM g.amount AND n.unit IS NOT DISTINCT FROM g.unit)
SELECT id, asked_id, store_id, found_id AS sp_id, CASE WHEN found_id IS NOT NULL THEN 'reused' WHEN price > 0 THEN 'unmatched' ELSE 'skipped_unpriced' END AS source,
  other AND reject IS NULL AND (found_id IS NOT NULL OR price > 0) AS crossed, CASE WHEN found_id IS NULL AND price > 0 THEN reject END AS reject, false AS heals FROM found""")
def er10(d: Domain):
    """All receipt lines; a fallback line comes without a choice, weighed goods without a printed size."""
    cat = chain_catalog(d)
    at_home = d.price.join(d.store.select("store_id", "chain_id"), "store_id").join(cat.select("sp_id", "chain_id"), ["sp_id", "chain_id"])
    latest = at_home.groupBy("sp_id").agg(F.max(F.struct("day", "id", "price"))["price"].alias("latest_price"))
    printed = d.sp.select(F.col("sp_id").alias("asked_id"), "name", *(F.when(~F.col("weighable"), F.col(c)).alias(c) for c in ("amount", "unit")), "weighable")
    sold = d.price.select("id", F.col("sp_id").alias("asked_id"), "store_id", "price", "is_fallback").join(d.store.select("store_id", "chain_id"), "store_id").join(printed, "asked_id")
    asked = sold.select(F.struct("id", "asked_id", "store_id").alias("line_id"), "chain_id", F.when(~F.col("is_fallback"), F.col("asked_id")).alias("sp_id"), F.lit(1.0).alias("confidence"), "name", "amount", "unit", "weighable", "price")
    return lines.resolved_lines(asked, cat, latest).select("line_id.*", "sp_id", "source", "crossed", "reject", "heals")


def offered(d: Domain, cat: DataFrame) -> DataFrame:
    """The newest promotion of each chain and name, with the item code that the chain prints beside it: the product's number."""
    promos = d.price.where("promo_price IS NOT NULL").join(d.store.select("store_id", "chain_id"), "store_id")
    named = promos.join(d.sp.select("sp_id", "product_id", "name", "amount", "unit", "weighable"), "sp_id")
    columns = ["sp_id", "product_id", "amount", "unit", "weighable", "price", "promo_price", "valid_from", "promo_end", "verified"]
    return ts.latest_by(named.select("chain_id", "name", "day", "id", *columns), ["chain_id", "name"], ["day", "id", *columns])


@query("er09_upserted_offers", NAMES_SQL + ", " + CATALOG_SQL + """,
promo AS (SELECT s.chain_id, sp.name AS shown, p.day, p.id, p.sp_id AS asked_id, sp.product_id AS item, sp.amount AS asked_amount, sp.unit AS asked_unit, sp.weighable AS asked_weighable, p.price, p.promo_price, p.valid_from, p.promo_end, p.verified
  FROM price p JOIN store s USING (store_id) JOIN sp ON sp.sp_id = p.sp_id WHERE promo_price IS NOT NULL),
offer AS (SELECT * FROM promo QUALIFY row_number() OVER (PARTITION BY chain_id, shown ORDER BY day DESC, id DESC, asked_id DESC, item DESC, asked_amount DESC, asked_unit DESC, asked_weighable DESC, price DESC, promo_price DESC, valid_from DESC, promo_end DESC NULLS LAST, verified DESC) = 1),
sold AS (SELECT sp_id, chain_id FROM listed),
asked AS (SELECT chain_id, asked_id, {normal} AS query, asked_amount, asked_unit, asked_weighable FROM offer)""".replace("{normal}", NORMAL_SQL.format("shown")) + chain_pairs_sql() + """{decisions},
exact AS (SELECT o.chain_id, o.asked_id, arg_min(l.sp_id, (NOT l.has_image, l.sp_id)) AS exact_id FROM offer o JOIN listed l ON l.chain_id = o.chain_id AND lower(l.name) = lower(o.shown) AND l.amount = o.asked_amount AND l.unit = o.asked_unit GROUP BY ALL),
placed AS (SELECT o.*, CASE WHEN exact_id IS NOT NULL THEN 'exact' ELSE d.via END AS how, coalesce(exact_id, CASE WHEN d.via = 'chain_sp' THEN d.sp_id END) AS sp_id, d.sp_id AS joined_id, d.category AS borrowed FROM offer o JOIN decided d USING (chain_id, asked_id) LEFT JOIN exact USING (chain_id, asked_id)),
code AS (SELECT s.chain_id, CAST(sp.product_id AS VARCHAR) AS code, arg_max(p.sp_id, (p.day, p.id, p.sp_id)) AS old_id FROM price p JOIN store s USING (store_id) JOIN sp ON sp.sp_id = p.sp_id WHERE p.day < DATE '2001-06-01' GROUP BY ALL),
coded AS (SELECT p.chain_id, p.asked_id, CASE WHEN old_id IS NULL THEN 'insert' WHEN old_id = p.sp_id THEN 'confirm' WHEN coalesce(own.amount, p.asked_amount) = old.amount THEN 'merge' ELSE 'move' END AS action
  FROM placed p LEFT JOIN code c ON c.chain_id = p.chain_id AND c.code = CAST(p.item AS VARCHAR) LEFT JOIN sp own ON own.sp_id = p.sp_id LEFT JOIN sp old ON old.sp_id = old_id WHERE item >= 100),
last AS (SELECT * FROM price QUALIFY row_number() OVER (PARTITION BY sp_id, store_id ORDER BY id DESC, day DESC, price DESC, promo_price DESC NULLS LAST) = 1),
written AS (SELECT p.chain_id, p.asked_id, CASE WHEN l.id IS NOT NULL AND abs(l.price - p.price) < 0.001 AND coalesce(abs(l.promo_price - p.promo_price) < 0.001, false) AND l.valid_from = p.valid_from THEN CASE WHEN coalesce(p.promo_end > l.promo_end, false) THEN 'extend' ELSE 'keep' END ELSE 'insert' END AS action
  FROM placed p JOIN store s USING (chain_id) LEFT JOIN last l ON l.sp_id = p.sp_id AND l.store_id = s.store_id),
cn AS (SELECT chain_id, asked_id, count(*) FILTER (action = 'insert') AS i, count(*) FILTER (action = 'confirm') AS c, count(*) FILTER (action = 'merge') AS m, count(*) FILTER (action = 'move') AS v FROM coded GROUP BY ALL),
wn AS (SELECT chain_id, asked_id, count(*) FILTER (action = 'insert') AS i, count(*) FILTER (action = 'extend') AS e, count(*) FILTER (action = 'keep') AS k FROM written GROUP BY ALL)
SELECT p.chain_id, p.asked_id, CASE WHEN p.sp_id IS NULL AND how = 'join' THEN 'sp_created' WHEN p.sp_id IS NULL THEN 'product_created' WHEN coalesce(wn.i, 0) > 0 THEN 'inserted' ELSE 'skipped' END AS result, how AS via, p.sp_id,
  CASE WHEN p.sp_id IS NOT NULL OR how = 'join' THEN t.product_id END AS product_id, CASE WHEN p.sp_id IS NULL AND how <> 'join' THEN borrowed END AS category, p.sp_id IS NULL AND how = 'mint_borrowed' AS review,
  coalesce(cn.i, 0) AS codes_insert, coalesce(cn.c, 0) AS codes_confirm, coalesce(cn.m, 0) AS codes_merge, coalesce(cn.v, 0) AS codes_move, coalesce(wn.i, 0) AS stores_insert, coalesce(wn.e, 0) AS stores_extend, coalesce(wn.k, 0) AS stores_keep,
  p.sp_id IS NOT NULL AND verified AND coalesce(cn.c, 0) + coalesce(cn.m, 0) > 0 AND p.shown <> t.name AS renamed, p.sp_id IS NOT NULL AND verified AND NOT t.has_image AS fills_image
FROM placed p LEFT JOIN listed t ON t.sp_id = coalesce(p.sp_id, CASE WHEN how = 'join' THEN joined_id END) LEFT JOIN cn ON cn.chain_id = p.chain_id AND cn.asked_id = p.asked_id LEFT JOIN wn ON wn.chain_id = p.chain_id AND wn.asked_id = p.asked_id""".replace("{decisions}", DECISION_SQL))
def er09(d: Domain):
    """The newest promotion of each chain and name as a scrape; codes known before the summer; verified offers speak with authority."""
    cat = chain_catalog(d)
    offers = offered(d, cat).withColumnRenamed("sp_id", "asked_id")
    normal = names.normal_name(F.col("name")).alias("query")
    asked = offers.select("chain_id", "asked_id", normal, F.col("amount").alias("asked_amount"), F.col("unit").alias("asked_unit"), F.col("weighable").alias("asked_weighable"))
    matches = decisions(asked, catalog(d), cat.select("sp_id", "chain_id"), confident_names(d)).select(F.struct("chain_id", "asked_id").alias("offer_id"), "via", "sp_id", "category")
    code = F.col("product_id").cast("string").alias("code")
    before = d.price.where(F.col("day") < F.lit("2001-06-01").cast("date")).join(d.store.select("store_id", "chain_id"), "store_id").join(d.sp.select("sp_id", "product_id"), "sp_id")
    codes = before.groupBy("chain_id", code).agg(F.max(F.struct("day", "id", "sp_id"))["sp_id"].alias("sp_id"))
    latest = ts.latest_by(d.price.select("sp_id", "store_id", "id", "day", "price", "promo_price", "valid_from", "promo_end"), ["sp_id", "store_id"], ts.TIES)
    latest = latest.select("sp_id", "store_id", "price", "promo_price", F.col("valid_from").alias("promo_start"), "promo_end", F.lit(False).alias("coupon"))
    batch = offers.select(
        F.struct("chain_id", "asked_id").alias("offer_id"), "chain_id", "name", "amount", "unit", F.array(F.format_string("%012d", "product_id")).alias("codes"), "price", "promo_price",
        F.col("valid_from").alias("promo_start"), "promo_end", F.lit(False).alias("coupon"), F.col("verified").alias("has_image"), F.col("verified").alias("name_authority"),
    )
    return upserts.upserted(batch, cat, matches, codes, latest, d.store).select("offer_id.*", *UPSERTED)


UPSERTED = ["result", "via", "sp_id", "product_id", "category", "review", "codes_insert", "codes_confirm", "codes_merge", "codes_move", "stores_insert", "stores_extend", "stores_keep", "renamed", "fills_image"]


def carried_over(d: Domain) -> DataFrame:
    """Lines of products that another chain lists, with buyer, price paid and the name on the receipt."""
    cat = chain_catalog(d).select("sp_id", "product_id", "name", F.col("chain_id").alias("home"))
    sold = d.price.select("id", "sp_id", "store_id", "receipt_id", F.coalesce("promo_price", "price").alias("paid")).join(d.store.select("store_id", "chain_id"), "store_id").join(cat, "sp_id").where("home != chain_id")
    return sold.join(d.receipt.select("receipt_id", "user_id"), "receipt_id")


@query("er30_minted_products")
def er30(d: Domain):
    """What every product that was bought outside its chain becomes there; a test holds the order of outcomes against a plain version."""
    confirms = carried_over(d).select("chain_id", F.col("sp_id").alias("source_id"), "user_id", F.struct("id", "store_id", "user_id").alias("confirm_id"))
    brands = d.table("part").select(F.col("p_partkey").alias("sp_id"), F.col("p_brand").alias("brand"))
    none = d.spark.createDataFrame([], "sp_id long, chain_id int, source_id long")
    return minting.minted(confirms, chain_catalog(d).join(brands, "sp_id"), none)


@query("er34_promoted_products")
def er34(d: Domain):
    """Products of a kind (four sizes share a number) brought to a chain, confirmed under the names that were printed; a test clusters them one by one."""
    confirms = carried_over(d).select("chain_id", "product_id", names.normal_name(F.col("name")).alias("print"), "user_id", "paid", F.struct("id", "sp_id", "user_id").alias("confirm_id"))
    return minting.promotions(confirms, ["chain_id", "product_id"])


def catalog_sides(d: Domain):
    """Products that have no category yet, and those that do, each under its chain and the words of its name."""
    chains = chain_catalog(d).select("sp_id", "chain_id")
    key = F.concat_ws(" ", F.col("chain_id").cast("string"), F.array_sort(F.split("name", " ")).cast("string")).alias("twin_key")
    keyed = catalog(d).join(chains, "sp_id").select("sp_id", "name", "category", key)
    homeless = keyed.where(F.col("category") == UNASSIGNED).select(F.col("sp_id").alias("id"), "name", "twin_key")
    return homeless, keyed.where(F.col("category") != UNASSIGNED).select(F.col("sp_id").alias("other_id"), "category", "name", "twin_key")


def votes_for_leaves(d: Domain, homeless: DataFrame) -> DataFrame:
    leaves = d.sp.where(F.col("category") != UNASSIGNED).select("category").distinct().select(F.lit(UNASSIGNED).alias("parent"), F.col("category").alias("leaf"), F.col("category").alias("leaf_name"))
    return rehoming.leaf_votes(homeless.select("id", "name", F.lit(UNASSIGNED).alias("category")), leaves)


def homeless_parts(d: Domain):
    """Products that have no category yet, those that do, and the pairs of the first with any."""
    homeless, homes = catalog_sides(d)
    cat = catalog(d)
    asked = cat.where(F.col("category") == UNASSIGNED).select(*asked_columns())
    pairs = scored_products(asked, cat, confident_names(d)).select(F.col("asked_id").alias("id"), F.col("sp_id").alias("other_id"), "confidence")
    return homeless, homes, pairs, votes_for_leaves(d, homeless)


@query("er31_new_homes")
def er31(d: Domain):
    """A category for every product that has none; a test repeats the rounds in a loop.

    Products that agree in name, size, unit and form are a kind; only kinds with a product that has no twin are scored.
    """
    homeless, homes = catalog_sides(d)
    cat = catalog(d)
    alike = ["name", "amount", "unit", "weighable"]
    kind = cat.groupBy(*alike).agg(F.min("sp_id").alias("kind"))
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in alike]
    kinds = files.cut(cat.join(kind.select(*(F.col(x).alias(f"_{x}") for x in alike), "kind"), same).select(F.col("sp_id").alias("id"), "kind"))
    single = homeless.join(rehoming.twins(homeless, homes), "id", "left_anti").join(kinds, "id").select(F.col("kind").alias("sp_id")).distinct()
    # No category counts in a score here, so a kind's first product speaks for it.
    one = kind.select(F.col("kind").alias("sp_id"), *alike, F.lit(None).cast("string").alias("category"))
    asked = one.join(single, "sp_id", "left_semi").select(*asked_columns())
    pairs = scored_products(asked, one, confident_names(d), itself=True).select(F.col("asked_id").alias("id"), F.col("sp_id").alias("other_id"), "confidence")
    return rehoming.rehomed(homeless, homes, pairs, votes_for_leaves(d, homeless), none=UNASSIGNED, kinds=kinds).withColumn("confidence", F.round("confidence", 6))


def confirmed_prints(d: Domain) -> DataFrame:
    """Every verified line's name beside the name that its kind of product goes by (its smallest size's)."""
    kinds = d.sp.groupBy("product_id").agg(F.min_by("name", "sp_id").alias("name"))
    printed = d.sp.select("sp_id", "product_id", F.col("name").alias("print"))
    return d.price.where("verified").select("sp_id").join(printed, "sp_id").join(kinds, "product_id").select("print", "name")


@query("er25_confusions")
def er25(d: Domain):
    """Letters that stand for others in the names of verified lines; a test aligns all of them one by one."""
    return confusions.confusions(confirmed_prints(d))


@query("er28_expanded_offers")
def er28(d: Domain):
    """Every sentence of every document read as an offer; most name one thing. The grammar's cases are held by a test."""
    lines = d.table("documents").select("doc_id", F.posexplode(F.split("text", r"[.!]\s")).alias("line_no", "name"))
    found = aggregated.expand_offers(lines)
    return found.select("doc_id", "line_no", "part", F.md5(F.col("product").cast("binary")).alias("product"), "size", "kinds")
