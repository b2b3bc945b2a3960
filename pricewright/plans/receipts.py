"""Queries over receipts, trips and their review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricewright.functions import names, scores
from pricewright.operators import timeseries as ts
from pricewright.plans.registry import query
from pricewright.sources.domain import AS_OF, Domain


def line_cents():
    return F.floor(F.col("price") * F.col("quantity") * 100 + 0.5)


CENTS_SQL = "CAST(floor(price * quantity * 100 + 0.5) AS BIGINT)"


@query("opt16_combo_attribution", f"""
l AS (SELECT receipt_id, id, sp_id, {CENTS_SQL} AS cents FROM price),
g AS (SELECT receipt_id, sum(cents)::BIGINT AS gross FROM l GROUP BY receipt_id),
s AS (SELECT l.*, g.gross // 20 AS discount, (g.gross // 20) * l.cents // g.gross AS base, row_number() OVER (PARTITION BY receipt_id ORDER BY l.cents DESC, l.id, l.sp_id) AS rn FROM l JOIN g USING (receipt_id)),
r AS (SELECT *, discount - sum(base) OVER (PARTITION BY receipt_id) AS rest FROM s)
SELECT id, sp_id, cents, CAST(least(cents, base + CASE WHEN rn <= rest THEN 1 ELSE 0 END) AS BIGINT) AS share FROM r""")
def opt16(d: Domain):
    """A receipt's discount over its lines in proportion, no line below zero, odd cents to the largest lines."""
    own = Window.partitionBy("receipt_id")
    lines = d.price.select("receipt_id", "id", "sp_id", line_cents().alias("cents")).withColumn("gross", F.sum("cents").over(own))
    based = lines.withColumn("base", F.expr("(gross div 20) * cents div gross")).withColumn("rn", F.row_number().over(own.orderBy(F.desc("cents"), "id", "sp_id")))
    rest = F.expr("gross div 20") - F.sum("base").over(own)
    return based.withColumn("rest", rest).select("id", "sp_id", "cents", F.least("cents", F.col("base") + F.when(F.col("rn") <= F.col("rest"), 1).otherwise(0)).alias("share"))


@query("opt17_combo_discount", f"SELECT receipt_id, least(sum({CENTS_SQL})::BIGINT // 10, 50000)::BIGINT AS discount FROM price GROUP BY receipt_id")
def opt17(d: Domain):
    return d.price.groupBy("receipt_id").agg(F.sum(line_cents()).alias("gross")).select("receipt_id", F.expr("least(gross div 10, 50000)").alias("discount"))


@query("opt18_trip_by_chain", f"""
t AS (SELECT r.user_id, r.day, s.chain_id, sum({CENTS_SQL})::BIGINT AS cents FROM receipt r JOIN price p USING (receipt_id) JOIN store s USING (store_id) GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS chains, min(cents) AS cheapest, median(cents) AS mid, max(cents) - min(cents) < 50 OR count(*) < 2 AS equal FROM t GROUP BY user_id, day""")
def opt18(d: Domain):
    lines = d.receipt.select("receipt_id", "user_id", F.col("day").alias("trip_day")).join(d.price, "receipt_id").join(d.store.select("store_id", "chain_id"), "store_id")
    t = lines.groupBy("user_id", "trip_day", "chain_id").agg(F.sum(line_cents()).alias("cents"))
    return t.groupBy("user_id", F.col("trip_day").cast("string").alias("day")).agg(F.count("*").alias("chains"), F.min("cents").alias("cheapest"), F.median("cents").alias("mid"), ((F.max("cents") - F.min("cents") < 50) | (F.count("*") < 2)).alias("equal"))


@query("opt06_fallback_pool", """
k AS (SELECT store_id, round(6371 * acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(55.0)) + cos(radians(lat)) * cos(radians(55.0)) * cos(radians(lng - 23.5))))), 6) AS km FROM store)
SELECT store_id FROM (SELECT store_id FROM k ORDER BY km, store_id LIMIT 12) UNION SELECT store_id FROM store WHERE store_id IN (1, 2, 3)""")
def opt06(d: Domain):
    km = F.round(scores.great_circle_km(F.col("lat"), F.col("lng"), F.lit(55.0), F.lit(23.5)), 6)
    nearest = d.store.orderBy(km, "store_id").limit(12).select("store_id")
    return nearest.union(d.store.where("store_id in (1, 2, 3)").select("store_id")).distinct()


@query("opt03_priced_items", """
SELECT id, CASE WHEN line_no = 1 THEN floor(quantity * price / 4 * 100 + 0.5) / 100 ELSE greatest(1, ceil(quantity / 4)) * price END AS total, CASE WHEN line_no = 1 THEN NULL ELSE CAST(greatest(1, ceil(quantity / 4)) AS BIGINT) END AS packs FROM price""")
def opt03(d: Domain):
    packs = F.greatest(F.lit(1), F.ceil(F.col("quantity") / 4))
    return d.price.select("id", F.when(F.col("line_no") == 1, F.floor(F.col("quantity") * F.col("price") / 4 * 100 + 0.5) / 100).otherwise(packs * F.col("price")).alias("total"), F.when(F.col("line_no") != 1, packs).alias("packs"))


@query("mth04_clamped_savings", "SELECT id, greatest(0, least(price, price - coalesce(promo_price, price))) AS savings FROM price")
def mth04(d: Domain):
    return d.price.select("id", F.greatest(F.lit(0.0), F.least("price", F.col("price") - F.coalesce("promo_price", "price"))).alias("savings"))


@query("rm22_scan_quality", f"""
l AS (SELECT receipt_id, count(*) AS n, count(*) FILTER (NOT verified) AS unmatched, sum({CENTS_SQL})::BIGINT AS cents FROM price GROUP BY receipt_id)
SELECT r.receipt_id, round(l.unmatched / l.n::DOUBLE, 6) AS unmatched, abs(r.cents - l.cents) AS gap, l.unmatched / l.n::DOUBLE > 0.5 OR abs(r.cents - l.cents) > 0.1 * r.cents AS poor FROM receipt r JOIN l USING (receipt_id)""")
def rm22(d: Domain):
    lines = d.price.groupBy("receipt_id").agg(F.count("*").alias("n"), F.count_if(~F.col("verified")).alias("u"), F.sum(line_cents()).alias("sum_cents"))
    share, gap = F.col("u") / F.col("n"), F.abs(F.col("cents") - F.col("sum_cents"))
    return d.receipt.join(lines, "receipt_id").select("receipt_id", F.round(share, 6).alias("unmatched"), gap.alias("gap"), ((share > 0.5) | (gap > 0.1 * F.col("cents"))).alias("poor"))


@query("rm24_flag_queue", """
lease AS (SELECT DISTINCT receipt_id * 1000 + line_no AS code FROM price WHERE verified AND receipt_id % 5 = 0)
SELECT p.receipt_id, p.line_no, count(*) AS issues FROM price p WHERE NOT p.verified AND p.is_fallback AND NOT EXISTS (SELECT 1 FROM lease l WHERE l.code // 1000 = p.receipt_id AND l.code % 1000 = p.line_no) GROUP BY ALL""")
def rm24(d: Domain):
    lease = d.price.where("verified and receipt_id % 5 = 0").select((F.col("receipt_id") * 1000 + F.col("line_no")).alias("code")).distinct()
    held = lease.select(F.expr("code div 1000").alias("receipt_id"), F.expr("CAST(code % 1000 AS INT)").alias("line_no"))
    return d.price.where("not verified and is_fallback").join(held, ["receipt_id", "line_no"], "left_anti").groupBy("receipt_id", "line_no").agg(F.count("*").alias("issues"))


@query("rm27_source_receipt", "SELECT product_id, receipt_id, line_no FROM price JOIN sp USING (sp_id) WHERE verified QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY day DESC, id DESC) = 1")
def rm27(d: Domain):
    p = d.price.where("verified").join(d.sp.select("sp_id", "product_id"), "sp_id")
    return p.groupBy("product_id").agg(F.max_by(F.struct("receipt_id", "line_no"), F.struct("day", "id")).alias("s")).select("product_id", "s.*")


@query("rm12_not_in_with_nulls", "SELECT count(*) AS n FROM receipt WHERE receipt_id NOT IN (SELECT CASE WHEN line_no < 7 THEN receipt_id END FROM price)")
def rm12(d: Domain):
    """NOT IN over a list that holds a null is never true: nothing is left, and that is kept."""
    ids = d.price.select(F.when(F.col("line_no") < 7, F.col("receipt_id")).alias("other"))
    has_null = ids.agg(F.max(F.col("other").isNull()).alias("has_null"))
    left = d.receipt.join(ids.where("other is not null"), F.col("receipt_id") == F.col("other"), "left_anti")
    return left.crossJoin(has_null).where("not coalesce(has_null, false)").agg(F.count("*").alias("n"))


@query("er19_needs_human", """
g AS (SELECT receipt_id, max(price) AS top FROM price GROUP BY receipt_id)
SELECT id, round((1 - (line_no % 5) / 5.0::DOUBLE) * price / top, 6) AS score FROM price JOIN g USING (receipt_id) WHERE NOT verified""")
def er19(d: Domain):
    """Ambiguity times the line's share of the dearest line."""
    top = d.price.groupBy("receipt_id").agg(F.max("price").alias("top"))
    return d.price.where("not verified").join(top, "receipt_id").select("id", F.round((1 - (F.col("line_no") % 5) / 5.0) * F.col("price") / F.col("top"), 6).alias("score"))


@query("er15_cross_chain_pairs", """
one AS (SELECT DISTINCT p.sp_id, s.chain_id, sp.name, sp.category FROM price p JOIN store s USING (store_id) JOIN sp USING (sp_id)),
capped AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY chain_id, category ORDER BY sp_id) <= 40)
SELECT a.chain_id AS chain_a, b.chain_id AS chain_b, a.sp_id AS a, b.sp_id AS b FROM capped a JOIN capped b ON a.category = b.category AND a.chain_id < b.chain_id AND a.name = b.name AND a.sp_id <> b.sp_id""")
def er15(d: Domain):
    """Every two chains: products of one name and category, from the first 40 products of a category in each chain (the deck's size)."""
    sold = d.price.select("sp_id", "store_id").join(d.store.select("store_id", "chain_id"), "store_id").join(d.sp.select("sp_id", "name", "category"), "sp_id").select("sp_id", "chain_id", "name", "category").distinct()
    capped = sold.withColumn("rn", F.row_number().over(Window.partitionBy("chain_id", "category").orderBy("sp_id"))).where("rn <= 40")
    side = lambda x: capped.select(F.col("chain_id").alias(f"chain_{x}"), F.col("sp_id").alias(x), "category", "name")
    return side("a").join(side("b"), ["category", "name"]).where("chain_a < chain_b and a != b").select("chain_a", "chain_b", "a", "b")


@query("er20_related_scope", "SELECT sp_id, count(*) OVER (PARTITION BY category, string_split(name, ' ')[2]) AS related FROM sp")
def er20(d: Domain):
    """How many products of its category have the same head word; counted per scope and joined, as a scope can be large."""
    headed = d.sp.select("sp_id", "category", F.get(F.split("name", " "), 1).alias("head"))
    return headed.join(headed.groupBy("category", "head").agg(F.count("*").alias("related")), ["category", "head"]).select("sp_id", "related")


@query("er26_match_audit", "SELECT store_id % 25 AS chain, round(count(*) FILTER (verified) / count(*)::DOUBLE, 6) AS matched, round(count(*) FILTER (verified AND is_fallback) / greatest(count(*) FILTER (verified), 1)::DOUBLE, 6) AS doubtful FROM price GROUP BY 1")
def er26(d: Domain):
    good = F.count_if("verified")
    return d.price.groupBy((F.col("store_id") % 25).alias("chain")).agg(F.round(good / F.count("*"), 6).alias("matched"), F.round(F.count_if(F.col("verified") & F.col("is_fallback")) / F.greatest(good, F.lit(1)), 6).alias("doubtful"))


@query("con08_star_roots", "SELECT sp_id, first_value(sp_id) OVER (PARTITION BY product_id ORDER BY length(name), sp_id) AS root FROM sp")
def con08(d: Domain):
    root = d.sp.groupBy("product_id").agg(F.min_by("sp_id", F.struct(F.length("name"), "sp_id")).alias("root"))
    return d.sp.join(root, "product_id").select("sp_id", "root")


@query("con13_vote_sources", "SELECT CASE WHEN dwell_ms < 500 THEN 'swipe' WHEN dwell_ms < 1200 THEN 'slot2' ELSE 'line' END AS source, vote, count(*) AS n FROM vote GROUP BY ALL")
def con13(d: Domain):
    return d.vote.groupBy(F.when(F.col("dwell_ms") < 500, "swipe").when(F.col("dwell_ms") < 1200, "slot2").otherwise("line").alias("source"), "vote").agg(F.count("*").alias("n"))


@query("con14_replay_without_user", "SELECT sp_a, count(*) FILTER (vote = 'identical') AS identical FROM vote WHERE user_id <> 7 GROUP BY sp_a")
def con14(d: Domain):
    return d.vote.where("user_id != 7").groupBy("sp_a").agg(F.count_if(F.col("vote") == "identical").alias("identical"))


@query("led06_scope_adjustment", f"SELECT receipt_id, (sum(CASE WHEN line_no % 2 = 0 THEN {CENTS_SQL} ELSE 0 END) - sum(CASE WHEN line_no % 3 = 0 THEN {CENTS_SQL} ELSE 0 END))::BIGINT AS delta FROM price GROUP BY receipt_id")
def led06(d: Domain):
    part = lambda k: F.sum(F.when(F.col("line_no") % k == 0, line_cents()).otherwise(0))
    return d.price.groupBy("receipt_id").agg((part(2) - part(3)).alias("delta"))


@query("rec01_trips", "SELECT r.user_id, CAST(r.day AS VARCHAR) AS day, count(DISTINCT p.sp_id) AS products FROM receipt r JOIN price p USING (receipt_id) GROUP BY r.user_id, r.day")
def rec01(d: Domain):
    bought = d.receipt.select("receipt_id", "user_id", F.col("day").cast("string").alias("trip_day")).join(d.price.select("receipt_id", "sp_id"), "receipt_id")
    return bought.groupBy("user_id", "trip_day").agg(F.countDistinct("sp_id").alias("products")).withColumnRenamed("trip_day", "day")


@query("rec11_planning_score", """
x AS (SELECT receipt_id, count(*) FILTER (verified) / count(*)::DOUBLE AS cov, count(*) FILTER (promo_price IS NOT NULL) / count(*)::DOUBLE AS disc, CASE WHEN min(store_id) % 10 <> 0 THEN 1 - (min(store_id) % 10) / 10.0::DOUBLE END AS store FROM price GROUP BY receipt_id)
SELECT receipt_id, CAST(floor(100 * (0.35 * cov + 0.35 * disc + 0.30 * coalesce(store, (cov + disc) / 2)) + 0.5) AS INT) AS score FROM x""")
def rec11(d: Domain):
    x = d.price.groupBy("receipt_id").agg((F.count_if("verified") / F.count("*")).alias("cov"), (F.count("promo_price") / F.count("*")).alias("disc"), F.min("store_id").alias("first"))
    store = F.when(F.col("first") % 10 != 0, 1 - (F.col("first") % 10) / 10.0)
    return x.select("receipt_id", F.floor(100 * (0.35 * F.col("cov") + 0.35 * F.col("disc") + 0.30 * F.coalesce(store, (F.col("cov") + F.col("disc")) / 2)) + 0.5).cast("int").alias("score"))


@query("rec16_open_counts", "SELECT user_id, count(*) FILTER (status <> 'F') AS open, count(*) FILTER (EXISTS (SELECT 1 FROM price p WHERE p.receipt_id = receipt.receipt_id)) AS covered FROM receipt GROUP BY user_id")
def rec16(d: Domain):
    has = d.price.select("receipt_id").distinct().withColumn("has", F.lit(True))
    return d.receipt.join(has, "receipt_id", "left").groupBy("user_id").agg(F.count_if(F.col("status") != "F").alias("open"), F.count("has").alias("covered"))


@query("top02_top_k_with_floor", "SELECT sp_a, sp_b, count(*) AS n FROM vote GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, sp_a, sp_b LIMIT 25")
def top02(d: Domain):
    return d.vote.groupBy("sp_a", "sp_b").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "sp_a", "sp_b").limit(25)


@query("top03_near_ties_in_bands", """
s AS (SELECT category, sp_id, weighable, list_price, max(list_price) OVER (PARTITION BY category) - list_price <= 5 AS near FROM sp)
SELECT category, sp_id FROM s WHERE near QUALIFY row_number() OVER (PARTITION BY category ORDER BY weighable DESC, list_price DESC, sp_id) = 1""")
def top03(d: Domain):
    """Within a margin of the best the preferred kind comes first. Bands start at the best, so the order is one."""
    best = d.sp.groupBy("category").agg(F.max("list_price").alias("best"))
    near = d.sp.join(best, "category").where("best - list_price <= 5")
    return near.groupBy("category").agg(F.max_by("sp_id", F.struct("weighable", "list_price", -F.col("sp_id"))).alias("sp_id"))


@query("top08_next_unvoted", "SELECT sp_a, min(rank) AS next FROM (SELECT sp_a, sp_b, row_number() OVER (PARTITION BY sp_a ORDER BY sp_b) AS rank, bool_or(vote = 'different') AS done FROM vote GROUP BY sp_a, sp_b) WHERE rank <= 5 AND NOT done GROUP BY sp_a")
def top08(d: Domain):
    pairs = d.vote.groupBy("sp_a", "sp_b").agg(F.max(F.col("vote") == "different").alias("done"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("sp_a").orderBy("sp_b")))
    return ranked.where("rank <= 5 and not done").groupBy("sp_a").agg(F.min("rank").alias("next"))


@query("top09_trip_order", "SELECT receipt_id FROM receipt WHERE user_id = 5 OR user_id = 6 ORDER BY status <> 'F' DESC, day DESC, receipt_id LIMIT 15")
def top09(d: Domain):
    return d.receipt.where("user_id in (5, 6)").orderBy((F.col("status") != "F").desc(), F.desc("day"), "receipt_id").limit(15).select("receipt_id")


@query("win02_prefer_real_then_newest", "SELECT sp_id, store_id, id FROM price QUALIFY row_number() OVER (PARTITION BY sp_id, store_id ORDER BY is_fallback, day DESC, id DESC) = 1")
def win02(d: Domain):
    return d.price.groupBy("sp_id", "store_id").agg(F.max_by("id", F.struct(~F.col("is_fallback"), "day", "id")).alias("id"))


@query("str02_without_sizes", "SELECT sp_id, trim(regexp_replace(regexp_replace(lower(name || ' 250 g'), '[0-9]+ g', ' ', 'g'), ' +', ' ', 'g')) AS name FROM sp")
def str02(d: Domain):
    return d.sp.select("sp_id", names.without_sizes(F.concat("name", F.lit(" 250 g"))).alias("name"))


@query("str10_edit_distance", "SELECT a.brand AS a, b.brand AS b, levenshtein(a.brand, b.brand)::INT AS distance FROM (SELECT DISTINCT brand FROM sp) a JOIN (SELECT DISTINCT brand FROM sp) b ON length(a.brand) = length(b.brand) AND a.brand < b.brand")
def str10(d: Domain):
    brands = d.sp.select("brand").distinct().withColumn("n", F.length("brand"))
    return brands.select(F.col("brand").alias("a"), "n").join(brands.select(F.col("brand").alias("b"), "n"), "n").where("a < b").select("a", "b", F.levenshtein("a", "b").alias("distance"))


@query("str17_receipt_numbers", "SELECT receipt_id, regexp_replace('R-' || lpad(CAST(receipt_id AS VARCHAR), 6, '0') || '/' || user_id, '[^0-9]', '', 'g') AS number FROM receipt")
def str17(d: Domain):
    written = F.concat(F.lit("R-"), F.lpad(F.col("receipt_id").cast("string"), 6, "0"), F.lit("/"), F.col("user_id").cast("string"))
    return d.receipt.select("receipt_id", F.regexp_replace(written, "[^0-9]", "").alias("number"))


@query("uni02_amount_in_name", "SELECT sp_id, amount = CAST(regexp_extract(name || ' ' || CAST(CAST(amount AS INT) + sp_id % 2 AS VARCHAR) || ' g', '([0-9]+) g', 1) AS DOUBLE) AS agrees FROM sp")
def uni02(d: Domain):
    written = F.concat("name", F.lit(" "), (F.col("amount").cast("int") + F.col("sp_id") % 2).cast("string"), F.lit(" g"))
    return d.sp.select("sp_id", (F.col("amount") == F.regexp_extract(written, "([0-9]+) g", 1).cast("double")).alias("agrees"))


@query("uni07_fixed_packs", "SELECT sp_id, unit IN ('vnt', 'pak') OR (unit IN ('g', 'ml') AND NOT weighable) AS fixed FROM sp")
def uni07(d: Domain):
    return d.sp.select("sp_id", (F.col("unit").isin("vnt", "pak") | (F.col("unit").isin("g", "ml") & ~F.col("weighable"))).alias("fixed"))


@query("agg06_json_objects", "SELECT brand, string_agg(sp_id || ':' || unit, ',' ORDER BY sp_id) AS entries, count(*) AS n FROM sp GROUP BY brand")
def agg06(d: Domain):
    """Ordered arrays of objects, written as JSON and read back."""
    made = F.to_json(F.sort_array(F.collect_list(F.struct("sp_id", "unit"))))
    back = F.from_json("j", "array<struct<sp_id:bigint,unit:string>>")
    return d.sp.groupBy("brand").agg(made.alias("j")).select("brand", F.array_join(F.transform(back, lambda x: F.concat(x["sp_id"].cast("string"), F.lit(":"), x["unit"])), ",").alias("entries"), F.json_array_length("j").cast("long").alias("n"))


@query("agg18_clamped_counters", "SELECT sp_a, greatest(0, count(*) FILTER (vote = 'identical') - count(*) FILTER (vote = 'different')) AS n FROM vote GROUP BY sp_a")
def agg18(d: Domain):
    return d.vote.groupBy("sp_a").agg(F.greatest(F.lit(0), F.count_if(F.col("vote") == "identical") - F.count_if(F.col("vote") == "different")).alias("n"))


@query("flt02_stemmed_search", "SELECT sp_id FROM sp WHERE contains(name, 'widg') AND contains(name, 'bl')")
def flt02(d: Domain):
    stem = lambda w: F.substring(F.lit(w), 1, max(2, len(w) - 2))
    return d.sp.where(F.contains("name", stem("widget")) & F.contains("name", stem("blue"))).select("sp_id")


@query("flt12_json_fallback", "SELECT event_id, coalesce(nullif(trim(props->>'$.missing'), ''), props->>'$.k') AS v FROM events")
def flt12(d: Domain):
    first = F.nullif(F.trim(F.get_json_object("props", "$.missing")), F.lit(""))
    return d.table("events").select("event_id", F.coalesce(first, F.get_json_object("props", "$.k")).alias("v"))


@query("flt16_allowed_columns", "SELECT receipt_id, CAST(day AS VARCHAR) AS day, status FROM receipt")
def flt16(d: Domain):
    return d.receipt.select("receipt_id", F.col("day").cast("string").alias("day"), "status")


@query("join02_left_outer", "SELECT r.receipt_id, count(p.id) AS lines FROM receipt r LEFT JOIN price p ON p.receipt_id = r.receipt_id AND p.verified GROUP BY r.receipt_id")
def join02(d: Domain):
    n = d.price.where("verified").groupBy("receipt_id").agg(F.count("*").alias("lines"))
    return d.receipt.select("receipt_id").join(n, "receipt_id", "left").select("receipt_id", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("join06_latest_self_join", "m AS (SELECT sp_id, store_id, max(id) AS id FROM price GROUP BY ALL) SELECT p.sp_id, p.store_id, p.id, max(p.price) AS price FROM price p JOIN m USING (sp_id, store_id, id) GROUP BY ALL")
def join06(d: Domain):
    return ts.latest_by(d.price.select("sp_id", "store_id", "id", "price"), ["sp_id", "store_id"], ["id", "price"])


@query("join12_stem_containment", "SELECT a.name AS a, b.name AS b FROM (SELECT DISTINCT name FROM sp) a JOIN (SELECT DISTINCT name FROM sp) b ON substring(a.name, 1, 4) = substring(b.name, 1, 4) AND a.name <> b.name AND contains(b.name, substring(string_split(a.name, ' ')[2], 1, 1))")
def join12(d: Domain):
    n = d.sp.select("name").distinct().withColumn("head", F.substring("name", 1, 4))
    a = n.select(F.col("name").alias("a"), "head", F.substring(F.get(F.split("name", " "), 1), 1, 1).alias("stem"))
    return a.join(n.select(F.col("name").alias("b"), "head"), "head").where(F.contains("b", F.col("stem")) & (F.col("a") != F.col("b"))).select("a", "b")


@query("snk06_keyed_update", "SELECT p.id, coalesce(u.price, p.price) AS price FROM price p LEFT JOIN (SELECT sp_id, store_id, min(price) AS price FROM price WHERE verified GROUP BY ALL) u USING (sp_id, store_id)")
def snk06(d: Domain):
    u = d.price.where("verified").groupBy("sp_id", "store_id").agg(F.min("price").alias("new"))
    return d.price.join(u, ["sp_id", "store_id"], "left").select("id", F.coalesce("new", "price").alias("price"))


@query("snk07_batched_delete", "SELECT count(*) AS n FROM price p WHERE NOT EXISTS (SELECT 1 FROM vote v WHERE v.vote_id = p.id AND v.vote = 'different')")
def snk07(d: Domain):
    return d.price.join(d.vote.where("vote = 'different'").select(F.col("vote_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("n"))


@query("set01_distinct_union", "SELECT sp_id AS id FROM price WHERE verified UNION SELECT sp_a FROM vote WHERE vote = 'similar'")
def set01(d: Domain):
    return d.price.where("verified").select(F.col("sp_id").alias("id")).union(d.vote.where("vote = 'similar'").select("sp_a")).distinct()


@query("set05_union_of_counts", "SELECT 'prices' AS kind, count(*) AS n FROM price UNION ALL SELECT 'receipts', count(*) FROM receipt UNION ALL SELECT 'votes', count(*) FROM vote")
def set05(d: Domain):
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return one("prices", d.price).union(one("receipts", d.receipt)).union(one("votes", d.vote))


@query("dat01_calendar", f"SELECT receipt_id, strftime(day, '%Y-%m') AS month, CAST(date_diff('day', day, DATE '{AS_OF}') AS INT) AS age, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS first FROM receipt")
def dat01(d: Domain):
    return d.receipt.select("receipt_id", F.date_format("day", "yyyy-MM").alias("month"), F.datediff(F.lit(AS_OF).cast("date"), "day").alias("age"), F.trunc("day", "month").cast("string").alias("first"))


@query("adm04_uncategorised_queue", "SELECT sp_id FROM sp WHERE category = 'PROMO' AND sp_id NOT IN (SELECT sp_a FROM vote WHERE vote = 'identical' AND dwell_ms > 1900) ORDER BY list_price DESC, sp_id LIMIT 30")
def adm04(d: Domain):
    acted = d.vote.where("vote = 'identical' and dwell_ms > 1900").select(F.col("sp_a").alias("sp_id"))
    return d.sp.where("category = 'PROMO'").join(acted, "sp_id", "left_anti").orderBy(F.desc("list_price"), "sp_id").limit(30).select("sp_id")


@query("adm10_amount_coverage", "SELECT category, count(*) AS n, count(*) FILTER (amount > 0 AND unit IS NOT NULL) AS sized, round(avg(amount), 4) AS mean FROM sp GROUP BY category")
def adm10(d: Domain):
    return d.sp.groupBy("category").agg(F.count("*").alias("n"), F.count_if((F.col("amount") > 0) & F.col("unit").isNotNull()).alias("sized"), F.round(F.avg("amount"), 4).alias("mean"))
