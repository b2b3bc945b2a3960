"""Queries over imports, exports, units of recipes, and what is left of read models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricewright.functions import names, scores
from pricewright.operators import files, greedy, similarity
from pricewright.operators.dealing import dealt
from pricewright.plans.matching import GRAM_SQL, NORMAL_SQL, SIM_SQL
from pricewright.plans.registry import query
from pricewright.plans.shopping import trips
from pricewright.sources.domain import Domain
from pricewright.streaming import feeds, timers


@query("src07_json_import", "SELECT category, count(*) AS n, sum(sp_id)::BIGINT AS ids, sum(amount) AS amount FROM sp GROUP BY category")
def src07(d: Domain):
    return files.exported(d.sp.select("sp_id", "category", "amount"), "json").groupBy("category").agg(F.count("*").alias("n"), F.sum("sp_id").alias("ids"), F.sum("amount").alias("amount"))


@query("snk05_csv_export", "SELECT brand, count(*) AS n, min(name) AS first FROM sp GROUP BY brand")
def snk05(d: Domain):
    return files.exported(d.sp.select("sp_id", "brand", "name"), "csv").groupBy("brand").agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query("snk04_rebuilt_summary", "SELECT store_id, count(*) AS n FROM price WHERE promo_price IS NOT NULL GROUP BY store_id")
def snk04(d: Domain):
    folder = files.scratch(d.spark)
    files.rebuilt(d.price.groupBy("store_id").agg(F.count("*").alias("n")), folder)
    return files.rebuilt(d.price.where("promo_price is not null").groupBy("store_id").agg(F.count("*").alias("n")), folder)


@query("src08_translated_names", "SELECT sp_id, CASE WHEN category = 'PROMO' THEN upper(name) ELSE name END AS label FROM sp")
def src08(d: Domain):
    translations = d.sp.where("category = 'PROMO'").select("sp_id", F.upper("name").alias("translated"))
    return d.sp.join(translations, "sp_id", "left").select("sp_id", F.coalesce("translated", "name").alias("label"))


#: Grams of one piece and density in grams a millilitre, by kind of product.
PIECE_GRAMS, DENSITY = 55.0, 1.03


@query("uni10_to_metric", "SELECT sp_id, round(CASE unit WHEN 'kg' THEN amount * 1000 WHEN 'g' THEN amount WHEN 'l' THEN amount * 1000 * 1.03 WHEN 'ml' THEN amount * 1.03 WHEN 'vnt' THEN amount * 55 END, 6) AS grams FROM sp")
def uni10(d: Domain):
    u, a = F.col("unit"), F.col("amount")
    grams = F.when(u == "kg", a * 1000).when(u == "g", a).when(u == "l", a * 1000 * DENSITY).when(u == "ml", a * DENSITY).when(u == "vnt", a * PIECE_GRAMS)
    return d.sp.select("sp_id", F.round(grams, 6).alias("grams"))


@query("uni11_written_numbers", """
SELECT sp_id, CASE sp_id % 4 WHEN 0 THEN amount + 0.5 WHEN 1 THEN amount / 4 WHEN 2 THEN amount + 0.25 ELSE amount END AS low, CASE WHEN sp_id % 4 = 3 THEN amount + 1 END AS high FROM sp""")
def uni11(d: Domain):
    """Whole numbers, fractions, mixed ones with glyphs, and ranges."""
    n = F.col("amount").cast("int").cast("string")
    written = F.when(F.col("sp_id") % 4 == 0, F.concat(n, F.lit(" 1/2"))).when(F.col("sp_id") % 4 == 1, F.concat(n, F.lit("/4"))).when(F.col("sp_id") % 4 == 2, F.concat(n, F.lit("¼"))).otherwise(F.concat(n, F.lit("-"), (F.col("amount").cast("int") + 1).cast("string")))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(written, "¼", " 1/4"), "½", " 1/2"), "¾", " 3/4")
    part = lambda p, i: F.regexp_extract(t, p, i).cast("double")
    mixed, fraction, span, whole = r"^(\d+) (\d+)/(\d+)$", r"^(\d+)/(\d+)$", r"^(\d+)-(\d+)$", r"^(\d+)$"
    low = F.when(t.rlike(mixed), part(mixed, 1) + part(mixed, 2) / F.nullif(part(mixed, 3), F.lit(0.0))).when(t.rlike(fraction), part(fraction, 1) / F.nullif(part(fraction, 2), F.lit(0.0))).when(t.rlike(span), part(span, 1)).otherwise(part(whole, 1))
    return d.sp.select("sp_id", low.alias("low"), F.when(t.rlike(span), part(span, 2)).alias("high"))


@query("uni12_shopping_amounts", """
SELECT sp_id, CASE WHEN weighable THEN least(5.0, ceil(amount / 3 * 10) / 10) WHEN unit IN ('vnt', 'pak') THEN least(12.0, ceil(amount / 3)) ELSE least(6.0, greatest(1.0, ceil(amount / 10))) END::DOUBLE AS buy FROM sp""")
def uni12(d: Domain):
    by_weight = F.least(F.lit(5.0), F.ceil(F.col("amount") / 3 * 10) / 10)
    pieces = F.least(F.lit(12.0), F.ceil(F.col("amount") / 3).cast("double"))
    packs = F.least(F.lit(6.0), F.greatest(F.lit(1.0), F.ceil(F.col("amount") / 10).cast("double")))
    return d.sp.select("sp_id", F.when(F.col("weighable"), by_weight).when(F.col("unit").isin("vnt", "pak"), pieces).otherwise(packs).alias("buy"))


@query("er16_orphan_candidates", f"""
o AS (SELECT DISTINCT {NORMAL_SQL.format('name || chr(32) || brand')} AS name FROM sp WHERE category = 'PROMO'), c AS (SELECT DISTINCT {NORMAL_SQL.format('name || chr(32) || brand')} AS name FROM sp WHERE category = 'SMALL'),
p AS (SELECT o.name AS orphan, c.name AS candidate, {SIM_SQL.format('o.name', 'c.name')} AS score FROM o JOIN c ON len(list_intersect({GRAM_SQL.format('o.name')}, {GRAM_SQL.format('c.name')})) >= 6)
SELECT orphan, candidate, score FROM p WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY orphan ORDER BY score DESC, candidate) <= 5""")
def er16(d: Domain):
    of = lambda kind: d.sp.where(F.col("category") == kind).select("name", "brand").distinct().select(names.normal_name(F.concat_ws(" ", "name", "brand")).alias("name")).distinct().select(F.col("name").alias("id"), "name")
    found = similarity.similarity_join(of("PROMO"), of("SMALL"), 0.4, 5, least_shared=6)
    return found.select(F.col("left_id").alias("orphan"), F.col("right_id").alias("candidate"), "score")


@query("rec06_greedy_fill")
def rec06(d: Domain):
    """Five slots per user; SQL can't express it, a test repeats it in plain Python."""
    item = trips(d).select("user_id", "trip_day", F.col("sp_id").alias("product_id"))
    baskets = item.groupBy("user_id", "trip_day").agg(F.sort_array(F.collect_list("product_id")).alias("ids"))
    # A user's trips are counted beside their baskets, so that the counts need no join.
    counted = baskets.select("user_id", "ids", F.count("trip_day").over(Window.partitionBy("user_id")).alias("n")).select("user_id", "n", F.explode("ids").alias("product_id"))
    # Written once, as the fill reads it three times over.
    p = files.rebuilt(counted.groupBy("user_id", "product_id").agg((F.count("*") / F.max("n")).alias("p")), files.scratch(d.spark))
    pairs = baskets.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    # Hardly a pair comes twice, so pairs are dealt out before they are counted.
    pairs = dealt(pairs, 2 * d.n_lines, "a", "b").groupBy("a", "b").agg((F.count("*") / 10.0).alias("score")).where("score > 0.1")
    return greedy.greedy_fill(p, pairs, 5)


@query("con09_reverification", """
f AS (SELECT sp_a, sp_b, max(day) FILTER (vote = 'identical') AS yes, max(day) FILTER (vote = 'different') AS no FROM vote GROUP BY ALL)
SELECT sp_a, sp_b FROM f WHERE yes IS NOT NULL AND no > yes""")
def con09(d: Domain):
    newest = lambda v: F.max(F.when(F.col("vote") == v, F.col("day")))
    return d.vote.groupBy("sp_a", "sp_b").agg(newest("identical").alias("yes"), newest("different").alias("no")).where("yes is not null and no > yes").select("sp_a", "sp_b")


@query("rm04_cluster_members", "SELECT a.sp_id, count(*) AS members FROM sp a JOIN sp b ON a.product_id = b.product_id GROUP BY a.sp_id")
def rm04(d: Domain):
    n = d.sp.groupBy("product_id").agg(F.count("*").alias("members"))
    return d.sp.join(n, "product_id").select("sp_id", "members")


@query("rm06_unified_search", """
l AS (SELECT DISTINCT sp_id FROM price JOIN store USING (store_id) WHERE chain_id = 3), hit AS (SELECT sp_id FROM sp WHERE contains(name, 'red')),
a AS (SELECT sp_id, 1 AS tier FROM hit WHERE sp_id IN (SELECT sp_id FROM l) ORDER BY sp_id LIMIT 40)
SELECT sp_id, tier FROM a UNION ALL SELECT sp_id, 2 FROM hit WHERE sp_id NOT IN (SELECT sp_id FROM l)""")
def rm06(d: Domain):
    local = d.price.select("sp_id", "store_id").join(d.store.where("chain_id = 3").select("store_id"), "store_id").select("sp_id").distinct()
    hit = d.sp.where(F.contains("name", F.lit("red"))).select("sp_id")
    near = hit.join(local, "sp_id", "left_semi").orderBy("sp_id").limit(40).withColumn("tier", F.lit(1))
    return near.unionByName(hit.join(local, "sp_id", "left_anti").withColumn("tier", F.lit(2)))


@query("rm10_list_items", "SELECT p.receipt_id, row_number() OVER (PARTITION BY p.receipt_id ORDER BY p.verified, p.id, p.sp_id) AS place, p.id, sp.category, coalesce(sp.weighable, false) AS weighable, p.verified AS checked FROM price p LEFT JOIN sp USING (sp_id)")
def rm10(d: Domain):
    joined = d.price.join(d.sp.select("sp_id", "category", "weighable"), "sp_id", "left")
    place = F.row_number().over(Window.partitionBy("receipt_id").orderBy("verified", "id", "sp_id"))
    return joined.select("receipt_id", place.alias("place"), "id", "category", F.coalesce("weighable", F.lit(False)).alias("weighable"), F.col("verified").alias("checked"))


@query("rm11_list_summaries", "SELECT receipt_id, count(*) AS items, count(*) FILTER (verified) AS done, bool_and(verified) AS completed FROM price GROUP BY receipt_id")
def rm11(d: Domain):
    return d.price.groupBy("receipt_id").agg(F.count("*").alias("items"), F.count_if("verified").alias("done"), F.min("verified").alias("completed"))


@query("rm20_resolve_cards", """
c AS (SELECT p.receipt_id, p.sp_id, round(max(CASE WHEN p.verified THEN 0.8 ELSE 0.4 END + CASE WHEN p.promo_price IS NOT NULL THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS rank FROM price p GROUP BY ALL)
SELECT receipt_id, sp_id, rank FROM c QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY rank DESC, sp_id) = 1""")
def rm20(d: Domain):
    rank = F.when(F.col("verified"), 0.8).otherwise(0.4) + F.when(F.col("promo_price").isNotNull(), 0.1).otherwise(0.0)
    c = d.price.groupBy("receipt_id", "sp_id").agg(F.round(F.max(rank), 6).alias("rank"))
    return c.groupBy("receipt_id").agg(F.max_by(F.struct("sp_id", "rank"), F.struct("rank", -F.col("sp_id"))).alias("b")).select("receipt_id", "b.*")


@query("rm25_chain_coverage", "SELECT sp_id, array_to_string(list_sort(list(DISTINCT chain_id)), ',') AS chains, count(DISTINCT chain_id) AS n FROM price JOIN store USING (store_id) GROUP BY sp_id")
def rm25(d: Domain):
    sold = d.price.select("sp_id", "store_id").join(d.store.select("store_id", "chain_id"), "store_id")
    return sold.groupBy("sp_id").agg(F.sort_array(F.collect_set("chain_id")).alias("c")).select("sp_id", F.array_join("c", ",").alias("chains"), F.size("c").cast("long").alias("n"))


@query("rm28_link_review", "SELECT sp_a, count(*) AS n FROM vote WHERE vote = 'similar' GROUP BY sp_a HAVING count(*) >= 12 ORDER BY n DESC, sp_a")
def rm28(d: Domain):
    return d.vote.where("vote = 'similar'").groupBy("sp_a").agg(F.count("*").alias("n")).where("n >= 12").orderBy(F.desc("n"), "sp_a")


@query("rm32_point_lookup", "SELECT store_id, chain_id FROM store WHERE store_id = 17")
def rm32(d: Domain):
    return d.store.where("store_id = 17").select("store_id", "chain_id")


@query("win06_anchor_pick", "SELECT product_id, sp_id FROM sp QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY weighable DESC, amount, sp_id) = 1")
def win06(d: Domain):
    return d.sp.withColumn("rn", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("weighable"), "amount", "sp_id"))).where("rn = 1").select("product_id", "sp_id")


#: The watermark that all events have passed at the end: the last event's time less an hour.
END_SQL = "e AS (SELECT *, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events{0}), w AS (SELECT max((epoch_us(ts) // 1000)) - 3600000 AS wm FROM events{0})"


@query("stm04_idle_users", END_SQL.format("") + """,
s AS (SELECT user_id, rn, ms, ms AS began, event_type = 'signup' AS planned, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.ms, CASE WHEN e.ms > s.ms + CASE WHEN planned THEN 604800000 ELSE 172800000 END THEN e.ms ELSE began END,
    e.event_type = 'signup' OR (planned AND e.ms <= s.ms + 604800000), CASE WHEN e.ms > s.ms + CASE WHEN planned THEN 604800000 ELSE 172800000 END THEN 1 ELSE n + 1 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1),
g AS (SELECT s.*, lead(ms) OVER (PARTITION BY user_id ORDER BY rn) AS later, CASE WHEN planned THEN 604800000 ELSE 172800000 END AS idle FROM s)
SELECT user_id, began, ms AS ended, planned, n FROM g, w WHERE CASE WHEN later IS NULL THEN ms + idle <= wm ELSE later > ms + idle END""")
def stm04(d: Domain):
    """Trips that ended: two days without an event of the user, a week once a list was begun."""
    kinds = {"signup": "list", "view": "seen", "click": "seen", "purchase": "seen", "error": "seen"}
    build = lambda s: timers.timed(timers.as_events(s, kinds), timers.IdleTrips(), timers.IDLE_SCHEMA)
    return timers.with_timers(d.spark, lambda: feeds.batch_of(build, d.spark, d.folder, "append")).withColumnRenamed("key", "user_id")


@query("stm05_lapsed_after_a_week", END_SQL.format(" WHERE event_type IN ('signup', 'purchase', 'error')") + """,
s AS (SELECT user_id, rn, CASE WHEN event_type = 'signup' THEN ms END AS open, NULL::BIGINT AS proposed, NULL::VARCHAR AS outcome, NULL::BIGINT AS done, NULL::BIGINT AS lapsed FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn,
    CASE WHEN open IS NULL OR e.ms > open + 604800000 THEN CASE WHEN event_type = 'signup' THEN ms END WHEN event_type = 'signup' THEN open END,
    CASE WHEN event_type <> 'signup' AND e.ms <= open + 604800000 THEN open END, CASE WHEN event_type <> 'signup' AND e.ms <= open + 604800000 THEN CASE event_type WHEN 'purchase' THEN 'confirmed' ELSE 'declined' END END,
    CASE WHEN event_type <> 'signup' AND e.ms <= open + 604800000 THEN e.ms END, CASE WHEN e.ms > open + 604800000 THEN open END
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
SELECT user_id, proposed, outcome, done AS at_ms FROM s WHERE outcome IS NOT NULL
UNION ALL SELECT user_id, lapsed, 'lapsed', lapsed + 604800000 FROM s WHERE lapsed IS NOT NULL
UNION ALL SELECT user_id, open, 'lapsed', open + 604800000 FROM last, w WHERE open + 604800000 <= wm""")
def stm05(d: Domain):
    """Proposals (sign-ups) that were confirmed by a purchase, declined by an error, or lapsed after a week."""
    kinds = {"signup": "propose", "purchase": "confirm", "error": "decline"}
    build = lambda s: timers.timed(timers.as_events(s, kinds), timers.LapsingSettlements(), timers.SETTLED_SCHEMA)
    found = timers.with_timers(d.spark, lambda: feeds.batch_of(build, d.spark, d.folder, "append"))
    return found.select(F.col("key").alias("user_id"), "proposed", "outcome", F.col("at").alias("at_ms"))


@query("stm09_nightly_decay", "SELECT user_id, round(sum(exp(-date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') / 90.0::DOUBLE)), 6) AS score FROM events GROUP BY user_id")
def stm09(d: Domain):
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date"))
    return feeds.batch_of(lambda s: s.groupBy("user_id").agg(F.round(F.sum(scores.decayed(F.lit(1.0), age)), 6).alias("score")), d.spark, d.folder)
