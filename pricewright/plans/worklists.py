"""Queries behind lists, queues and write paths: baskets, ledgers, candidates, receipts, categories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricewright.functions import names, units
from pricewright.operators import files
from pricewright.operators.dealing import dealt
from pricewright.operators.pairing import gathered, paired_groups
from pricewright.plans.matching import NORMAL_SQL
from pricewright.plans.registry import query
from pricewright.plans.resolution import UNASSIGNED
from pricewright.sources.domain import AS_OF, Domain

SOLD_SQL = "sold AS (SELECT DISTINCT sp_id, chain_id FROM price JOIN store USING (store_id))"


def sold(d: Domain):
    return d.price.select("sp_id", "store_id").join(d.store.select("store_id", "chain_id"), "store_id").select("sp_id", "chain_id").distinct()


@query("rm05_chain_siblings", SOLD_SQL + """
SELECT s.sp_id, o.chain_id, o.sp_id AS sibling FROM sp s JOIN sp x ON x.product_id = s.product_id AND x.sp_id <> s.sp_id JOIN sold o ON o.sp_id = x.sp_id
QUALIFY row_number() OVER (PARTITION BY s.sp_id, o.chain_id ORDER BY o.sp_id) <= 40""")
def rm05(d: Domain):
    """What each chain sells of a product besides the listed article; forty a chain, as many as a search shows."""
    of = d.sp.select("sp_id", "product_id")
    pairs = of.join(of.withColumnRenamed("sp_id", "sibling"), "product_id").where("sp_id != sibling").join(sold(d).withColumnRenamed("sp_id", "sibling"), "sibling")
    order = Window.partitionBy("sp_id", "chain_id").orderBy("sibling")
    return pairs.withColumn("rn", F.row_number().over(order)).where("rn <= 40").select("sp_id", "chain_id", "sibling")


BASKET_SQL = "b AS (SELECT r.receipt_id, r.user_id, r.day, r.status, coalesce(c.calculated, false) AS calculated FROM receipt r LEFT JOIN (SELECT receipt_id, bool_or(verified) AS calculated FROM price GROUP BY receipt_id) c USING (receipt_id))"


#: A draft can be resumed for 48 hours.
DRAFT_DAYS = 2


@query("rm09_resumable_baskets", f"""{BASKET_SQL}
SELECT user_id, arg_max(receipt_id, day::VARCHAR || lpad(receipt_id::VARCHAR, 12, '0')) FILTER (status <> 'F' AND calculated) AS active,
  arg_max(receipt_id, day::VARCHAR || lpad(receipt_id::VARCHAR, 12, '0')) FILTER (status = 'O' AND day >= DATE '{AS_OF}' - 2) AS draft, count(*) FILTER (status <> 'F' AND NOT calculated) AS abandoned FROM b GROUP BY user_id""")
def rm09(d: Domain):
    """Per user the newest open basket that was priced, the newest recent draft, and how many were left untouched."""
    priced = d.price.groupBy("receipt_id").agg(F.max("verified").alias("calculated"))
    b = d.receipt.join(priced, "receipt_id", "left").withColumn("calculated", F.coalesce("calculated", F.lit(False)))
    newest = lambda cond: F.max(F.when(cond, F.struct("day", "receipt_id")))["receipt_id"]
    recent = F.col("day") >= F.date_sub(F.lit(AS_OF).cast("date"), DRAFT_DAYS)
    return b.groupBy("user_id").agg(
        newest((F.col("status") != "F") & F.col("calculated")).alias("active"), newest((F.col("status") == "O") & recent).alias("draft"), F.count_if((F.col("status") != "F") & ~F.col("calculated")).alias("abandoned")
    )


@query("rm17_ledger_page", """
e AS (SELECT p.household_id, r.day, r.receipt_id, r.cents FROM receipt r JOIN person p USING (user_id) WHERE r.day < DATE '2000-01-01' OR (r.day = DATE '2000-01-01' AND r.receipt_id < 5000)),
r AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY day DESC, receipt_id DESC) AS place FROM e)
SELECT household_id, receipt_id, cents, place, count(*) OVER (PARTITION BY household_id) > 20 AS more FROM r WHERE place <= 21 QUALIFY place <= 20""")
def rm17(d: Domain):
    """Of every household the twenty entries before a cursor (day, id), newest first, and whether there are more."""
    day = F.lit("2000-01-01").cast("date")
    before = (F.col("day") < day) | ((F.col("day") == day) & (F.col("receipt_id") < 5000))
    e = d.receipt.where(before).join(d.user.select("user_id", "household_id"), "user_id")
    page = e.withColumn("place", F.row_number().over(Window.partitionBy("household_id").orderBy(F.desc("day"), F.desc("receipt_id")))).where("place <= 21")
    return page.withColumn("more", F.max("place").over(Window.partitionBy("household_id")) > 20).where("place <= 20").select("household_id", "receipt_id", "cents", "place", "more")


@query("rm19_candidate_details", """
p AS (SELECT sp_a, sp_b - 100000 AS other, count(DISTINCT user_id) AS voters, max(vote_id) AS last_vote FROM vote GROUP BY ALL)
SELECT p.sp_a, p.other, p.voters, p.last_vote, a.name AS name, o.name AS other_name, a.unit = o.unit AS same_unit, a.category = o.category AS same_category FROM p JOIN sp a ON a.sp_id = p.sp_a JOIN sp o ON o.sp_id = p.other""")
def rm19(d: Domain):
    # Dealt by the first product once, for the voters, the counts and that product's names.
    p = dealt(d.vote.select("sp_a", (F.col("sp_b") - 100000).alias("other"), "user_id", "vote_id"), d.n_lines, "sp_a").groupBy("sp_a", "other").agg(F.count_distinct("user_id").alias("voters"), F.max("vote_id").alias("last_vote"))
    a = d.sp.select(F.col("sp_id").alias("sp_a"), "name", "unit", "category")
    o = d.sp.select(F.col("sp_id").alias("other"), F.col("name").alias("other_name"), F.col("unit").alias("ou"), F.col("category").alias("oc"))
    return dealt(p.join(a, "sp_a"), d.n_lines, "other").join(o, "other").select("sp_a", "other", "voters", "last_vote", "name", "other_name", (F.col("unit") == F.col("ou")).alias("same_unit"), (F.col("category") == F.col("oc")).alias("same_category"))


@query("rm26_candidate_upsert", """
kept AS (SELECT * FROM vote WHERE sp_a IN (SELECT sp_id FROM price WHERE verified) AND sp_b - 100000 IN (SELECT sp_id FROM sp)),
n AS (SELECT sp_a, sp_b, max(dwell_ms) FILTER (day < DATE '2000-01-01') AS stored, max(dwell_ms) FILTER (day >= DATE '2000-01-01') AS fresh FROM kept GROUP BY ALL)
SELECT sp_a, sp_b, coalesce(fresh, stored) AS score, CASE WHEN stored IS NULL THEN 'inserted' WHEN fresh IS NULL THEN 'kept' ELSE 'updated' END AS action FROM n""")
def rm26(d: Domain):
    """New candidates over the stored ones, by pair; pairs of which a product is gone drop out before."""
    live = d.price.where("verified").select(F.col("sp_id").alias("sp_a")).distinct()
    # Inner joins with distinct ids: semi joins would be held before the votes are dealt out.
    known = d.sp.select((F.col("sp_id") + 100000).alias("sp_b")).distinct().hint("merge")
    votes = dealt(d.vote.select("sp_a", "sp_b", "day", "dwell_ms"), d.n_lines, "sp_b").join(known, "sp_b")
    kept = dealt(votes, d.n_lines, "sp_a").join(live, "sp_a")
    fresh = F.col("day") >= F.lit("2000-01-01").cast("date")
    n = kept.groupBy("sp_a", "sp_b").agg(F.max(F.when(~fresh, F.col("dwell_ms"))).alias("stored"), F.max(F.when(fresh, F.col("dwell_ms"))).alias("fresh"))
    action = F.when(F.col("stored").isNull(), "inserted").when(F.col("fresh").isNull(), "kept").otherwise("updated")
    return n.select("sp_a", "sp_b", F.coalesce("fresh", "stored").alias("score"), action.alias("action"))


@query("rm29_receipt_admin_page", """
done AS (SELECT * FROM receipt WHERE status <> 'P'), n AS (SELECT count(*) AS total FROM done),
page AS (SELECT * FROM done ORDER BY receipt_id DESC LIMIT 20 OFFSET 20)
SELECT p.receipt_id, p.user_id, p.cents, n.total, (SELECT count(*) FROM price x WHERE x.receipt_id = p.receipt_id) AS lines, EXISTS (SELECT 1 FROM price x WHERE x.receipt_id = p.receipt_id AND x.is_fallback AND NOT x.verified) AS flagged FROM page p, n""")
def rm29(d: Domain):
    """The second page of twenty finished receipts with their lines, whether one is flagged, and how many receipts there are."""
    done = d.receipt.where("status != 'P'")
    page = done.orderBy(F.desc("receipt_id")).offset(20).limit(20).select("receipt_id", "user_id", "cents")
    # The page is twenty rows, so it goes to the lines and not they to it.
    lines = d.price.join(F.broadcast(page.select("receipt_id")), "receipt_id").groupBy("receipt_id").agg(F.count("*").alias("lines"), F.max(F.col("is_fallback") & ~F.col("verified")).alias("flagged"))
    return page.join(lines, "receipt_id", "left").crossJoin(done.agg(F.count("*").alias("total"))).select("receipt_id", "user_id", "cents", "total", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("rm30_trip_links", """
t AS (SELECT user_id, day, min(receipt_id) AS trip, count(*) AS receipts FROM receipt GROUP BY ALL),
used AS (SELECT DISTINCT receipt_id FROM price)
SELECT t.trip, t.receipts, count(u.receipt_id) AS filled, count(u.receipt_id) = 0 AS collectable FROM t JOIN receipt r USING (user_id, day) LEFT JOIN used u USING (receipt_id) GROUP BY t.trip, t.receipts""")
def rm30(d: Domain):
    """Receipts of one user and day make a trip; a trip with nothing in any of its receipts may be collected."""
    used = d.price.select("receipt_id").distinct().withColumn("used", F.lit(1))
    linked = d.receipt.select("receipt_id", "user_id", "day").join(used, "receipt_id", "left")
    t = linked.groupBy("user_id", "day").agg(F.min("receipt_id").alias("trip"), F.count("*").alias("receipts"), F.count("used").alias("filled"))
    return t.select("trip", "receipts", "filled", (F.col("filled") == 0).alias("collectable"))


@query("rm31_receipt_deletion", """
gone AS (SELECT receipt_id FROM receipt WHERE status = 'P'), rest AS (SELECT * FROM price WHERE receipt_id NOT IN (SELECT receipt_id FROM gone)),
l AS (SELECT sp_id, store_id, max(id) AS id FROM rest GROUP BY ALL), before AS (SELECT sp_id, store_id, max(id) AS id FROM price GROUP BY ALL)
SELECT b.sp_id, b.store_id, l.id AS latest, CASE WHEN l.id IS NULL THEN 'removed' WHEN l.id = b.id THEN 'same' ELSE 'rewritten' END AS effect FROM before b LEFT JOIN l USING (sp_id, store_id)""")
def rm31(d: Domain):
    """What deleting the pending receipts does to the latest price of every product and store: prices once with their receipt's fate."""
    gone = d.receipt.where("status = 'P'").select("receipt_id", F.lit(True).alias("gone"))
    g = d.price.join(gone, "receipt_id", "left").groupBy("sp_id", "store_id").agg(F.max("id").alias("before"), F.max(F.when(F.col("gone").isNull(), F.col("id"))).alias("latest"))
    effect = F.when(F.col("latest").isNull(), "removed").when(F.col("latest") == F.col("before"), "same").otherwise("rewritten")
    return g.select("sp_id", "store_id", "latest", effect.alias("effect"))


@query("snk03_bulk_insert", "SELECT store_id, count(*) AS n, sum(CAST(floor(price * 100 + 0.5) AS BIGINT))::BIGINT AS cents FROM price GROUP BY store_id")
def snk03(d: Domain):
    """Verified and other prices appended to one table in two writes, and read back."""
    folder, rows = files.scratch(d.spark), d.price.select("id", "store_id", "price", "verified")
    for part in (rows.where("verified"), rows.where("not verified")):
        part.write.mode("append").parquet(folder)
    return d.spark.read.schema(rows.schema).parquet(folder).groupBy("store_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("price") * 100 + 0.5)).alias("cents"))


@query("adm02_image_queue", """
shown AS (SELECT DISTINCT sp_id FROM price WHERE verified AND day >= DATE '2001-01-01'), n AS (SELECT sp_id, count(*) AS asked FROM price GROUP BY sp_id)
SELECT s.category, s.sp_id, n.asked, EXISTS (SELECT 1 FROM sp x JOIN shown USING (sp_id) WHERE x.product_id = s.product_id) AS donor FROM sp s JOIN n USING (sp_id) WHERE s.sp_id NOT IN (SELECT sp_id FROM shown)
QUALIFY row_number() OVER (PARTITION BY s.category ORDER BY n.asked DESC, s.sp_id) <= 10""")
def adm02(d: Domain):
    """Per category the ten most wanted products without an image of this year's offers, and whether a sibling could give one."""
    n = d.price.groupBy("sp_id").agg(F.count("*").alias("asked"), F.max(F.col("verified") & (F.col("day") >= F.lit("2001-01-01").cast("date"))).alias("shown"))
    s = d.sp.select("sp_id", "category", "product_id").join(n, "sp_id")
    donors = s.where("shown").select("product_id").distinct().withColumn("donor", F.lit(True))
    order = Window.partitionBy("category").orderBy(F.desc("asked"), "sp_id")
    top = s.where("not shown").withColumn("rn", F.row_number().over(order)).where("rn <= 10")
    return top.join(donors, "product_id", "left").select("category", "sp_id", "asked", F.coalesce("donor", F.lit(False)).alias("donor"))


CONFIRMED_SQL = "confirmed AS (SELECT sp_a AS a, sp_b - 100000 AS b, count(DISTINCT user_id) AS k FROM vote WHERE vote = 'identical' AND sp_a <> sp_b - 100000 GROUP BY ALL)"


def confirmed(d: Domain):
    other = F.col("sp_b") - 100000
    return d.vote.where((F.col("vote") == "identical") & (F.col("sp_a") != other)).groupBy(F.col("sp_a").alias("a"), other.alias("b")).agg(F.count_distinct("user_id").alias("k"))


@query("con05_categorise_on_merge", f"""{CONFIRMED_SQL},
both_ways AS (SELECT a, b, k FROM confirmed UNION ALL SELECT b, a, k FROM confirmed),
offer AS (SELECT x.a AS sp_id, o.category, sum(x.k)::BIGINT AS k FROM both_ways x JOIN sp s ON s.sp_id = x.a AND s.category = '{UNASSIGNED}' JOIN sp o ON o.sp_id = x.b AND o.category <> '{UNASSIGNED}' GROUP BY ALL)
SELECT sp_id, category FROM offer QUALIFY row_number() OVER (PARTITION BY sp_id ORDER BY k DESC, category) = 1""")
def con05(d: Domain):
    """A product without a category takes that of the products it is merged with; one that has a category keeps it."""
    pairs = confirmed(d)
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))
    open_ = d.sp.where(F.col("category") == UNASSIGNED).select(F.col("sp_id").alias("a"))
    known = d.sp.where(F.col("category") != UNASSIGNED).select(F.col("sp_id").alias("b"), "category")
    offer = ways.join(open_, "a", "left_semi").join(known, "b").groupBy(F.col("a").alias("sp_id"), "category").agg(F.sum("k").alias("k"))
    return offer.groupBy("sp_id").agg(F.min_by("category", F.struct(-F.col("k"), "category")).alias("category"))


@query("er32_personal_category", f"""
mine AS (SELECT v.user_id, v.sp_a AS sp_id, arg_max(o.category, v.vote_id * 1000000 + v.sp_b) AS personal FROM vote v JOIN sp o ON o.sp_id = v.sp_b - 100000 WHERE v.vote = 'identical' AND o.category <> '{UNASSIGNED}' GROUP BY ALL)
SELECT p.id, p.sp_id, CASE WHEN s.category = '{UNASSIGNED}' THEN coalesce(m.personal, s.category) ELSE s.category END AS category, coalesce(s.category = '{UNASSIGNED}' AND m.personal IS NOT NULL, false) AS rescued
FROM price p JOIN receipt r USING (receipt_id) JOIN sp s ON s.sp_id = p.sp_id LEFT JOIN mine m ON m.user_id = r.user_id % 500 AND m.sp_id = p.sp_id""")
def er32(d: Domain):
    """Lines as their buyer sees them: a product without a category shows that of what the buyer declared it equal to, at last."""
    known = d.sp.where(F.col("category") != UNASSIGNED).select((F.col("sp_id") + 100000).alias("sp_b"), "category")
    mine = d.vote.where("vote = 'identical'").join(known, "sp_b").groupBy("user_id", F.col("sp_a").alias("sp_id")).agg(F.max_by("category", F.struct("vote_id", "sp_b")).alias("personal"))
    lines = d.price.select("id", "sp_id", "receipt_id").join(d.receipt.select("receipt_id", (F.col("user_id") % 500).alias("user_id")), "receipt_id").join(d.sp.select("sp_id", "category"), "sp_id")
    rescued = (F.col("category") == UNASSIGNED) & F.col("personal").isNotNull()
    seen = lines.join(mine, ["user_id", "sp_id"], "left")
    return seen.select("id", "sp_id", F.when(rescued, F.col("personal")).otherwise(F.col("category")).alias("category"), F.coalesce(rescued, F.lit(False)).alias("rescued"))


@query("str20_category_paths", f"""
node AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, {NORMAL_SQL.format('r_name')} AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, {NORMAL_SQL.format('n_name')} FROM nation),
p AS (SELECT c.c_custkey AS user_id, {NORMAL_SQL.format('r.r_name')} AS s1, {NORMAL_SQL.format('c.c_mktsegment')} AS s2, {NORMAL_SQL.format('n.n_name')} AS s3 FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT p.user_id, (SELECT id FROM node WHERE parent IS NULL AND name = p.s1) AS strict, (SELECT min(id) FROM node WHERE name = p.s3) AS flat FROM p""")
def str20(d: Domain):
    """Where a path of names leads: region, segment, nation stops at the region, as no region has a segment below it; the nation alone is found anywhere."""
    normal = lambda c: names.normal_name(F.col(c))
    top = d.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), normal("r_name").alias("name"))
    node = top.unionByName(d.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), normal("n_name").alias("name")))
    geo = d.table("nation").join(d.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), normal("r_name").alias("s1"), normal("n_name").alias("s3"))
    asked = d.table("customer").join(geo, "c_nationkey").select(F.col("c_custkey").alias("user_id"), "s1", normal("c_mktsegment").alias("s2"), "s3")
    strict = names.walked(asked.select("user_id", F.array("s1", "s2", "s3").alias("path")), node, "user_id").select("user_id", F.col("found").alias("strict"))
    flat = names.walked(asked.select("user_id", F.array("s3").alias("path")), node, "user_id").select("user_id", F.col("found").alias("flat"))
    return strict.join(flat, "user_id")


@query("str18_user_names", """
SELECT c_custkey AS user_id, CASE WHEN length(trim(c_name)) < 3 THEN 'too-short' WHEN length(trim(c_name)) > 20 THEN 'too-long' WHEN NOT regexp_full_match(lower(trim(c_name)), '[a-z0-9_.]+') THEN 'bad-format' ELSE 'ok' END AS of_name,
  CASE WHEN length(trim(c_mktsegment)) < 3 THEN 'too-short' WHEN length(trim(c_mktsegment)) > 20 THEN 'too-long' WHEN NOT regexp_full_match(lower(trim(c_mktsegment)), '[a-z0-9_.]+') THEN 'bad-format' ELSE 'ok' END AS of_segment FROM customer""")
def str18(d: Domain):
    return d.table("customer").select(F.col("c_custkey").alias("user_id"), names.user_name_verdict(F.col("c_name")).alias("of_name"), names.user_name_verdict(F.col("c_mktsegment")).alias("of_segment"))


@query("rec05_interpolated_pairs", """
item AS (SELECT DISTINCT r.user_id, r.day, p.sp_id FROM receipt r JOIN price p USING (receipt_id)),
mine AS (SELECT x.user_id, x.sp_id AS a, y.sp_id AS b, count(*) AS co FROM item x JOIN item y ON x.user_id = y.user_id AND x.day = y.day AND x.sp_id < y.sp_id GROUP BY ALL),
trips AS (SELECT user_id, count(DISTINCT day) AS n FROM item GROUP BY user_id), whole AS (SELECT sum(n)::BIGINT AS n FROM trips), world AS (SELECT a, b, sum(co)::BIGINT AS co FROM mine GROUP BY ALL)
SELECT m.user_id, m.a, m.b, round(m.co / (m.co + 5.0::DOUBLE) * (m.co / t.n::DOUBLE) + 5.0::DOUBLE / (m.co + 5.0::DOUBLE) * (w.co / whole.n::DOUBLE), 8) AS score FROM mine m JOIN trips t USING (user_id) JOIN world w USING (a, b), whole""")
def rec05(d: Domain):
    """A user's pairs of products: their share of the user's trips, the more trusted the oftener seen, else that of all trips.

    Pairs that a user never bought together have the score of all users and aren't repeated for each.
    """
    # Dealt by user once, which serves trips, pairs and counts alike.
    item = d.receipt.select("receipt_id", "user_id", F.col("day").alias("trip_day")).join(d.price.select("receipt_id", "sp_id"), "receipt_id").select("user_id", "trip_day", "sp_id").repartition("user_id").distinct()
    baskets = item.groupBy("user_id", "trip_day").agg(F.sort_array(F.collect_list("sp_id")).alias("ids"))  # one trip's products
    mine = baskets.select("user_id", F.posexplode("ids").alias("i", "a"), "ids").select("user_id", "a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b")).groupBy("user_id", "a", "b").agg(F.count("*").alias("co"))
    trips = baskets.groupBy("user_id").agg(F.count("*").alias("n"))
    world = mine.groupBy("a", "b").agg(F.sum("co").alias("all_co"))
    scored = mine.join(trips, "user_id").join(world, ["a", "b"]).crossJoin(baskets.agg(F.count("*").alias("all_n")))
    trust = F.col("co") / (F.col("co") + 5.0)
    return scored.select("user_id", "a", "b", F.round(trust * (F.col("co") / F.col("n")) + F.lit(5.0) / (F.col("co") + 5.0) * (F.col("all_co") / F.col("all_n")), 8).alias("score"))


@query("rec12_same_kind", f"""
l AS (SELECT p.receipt_id, p.line_no, p.sp_id, s.product_id, s.category, list_filter(string_split({NORMAL_SQL.format('s.name')}, ' '), lambda w: length(w) >= 4) AS ws FROM price p JOIN sp s USING (sp_id))
SELECT DISTINCT a.receipt_id, least(a.sp_id, b.sp_id) AS a, greatest(a.sp_id, b.sp_id) AS b, CASE WHEN a.product_id = b.product_id THEN 'product' WHEN len(list_intersect(a.ws, b.ws)) > 0 THEN 'name' ELSE 'category' END AS kind
FROM l a JOIN l b ON a.receipt_id = b.receipt_id AND a.sp_id < b.sp_id WHERE a.product_id = b.product_id OR len(list_intersect(a.ws, b.ws)) > 0 OR (a.category = b.category AND a.category <> '{UNASSIGNED}')""")
def rec12(d: Domain):
    """Two products of one receipt that are the same kind of thing: by product, by a long word of the name, or by category."""
    s = d.sp.select("sp_id", "product_id", "category", F.filter(F.split(names.normal_name(F.col("name")), " "), lambda w: F.length(w) >= 4).alias("ws"))
    l = d.price.select("receipt_id", "sp_id").distinct().join(s, "sp_id")
    a, b = (l.select("receipt_id", F.col("sp_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("product_id", "category", "ws"))) for x in "ab")
    kind = F.when(F.col("product_id_a") == F.col("product_id_b"), "product").when(F.arrays_overlap("ws_a", "ws_b"), "name").when((F.col("category_a") == F.col("category_b")) & (F.col("category_a") != UNASSIGNED), "category")
    return a.join(b, "receipt_id").where("a < b").select("receipt_id", "a", "b", kind.alias("kind")).where("kind is not null")


@query("join13_list_and_receipt")
def join13(d: Domain):
    """Each receipt against the user's receipt before it, as the list: lines paired one to one by product, then name, then category.

    A test holds the pairs against a plain greedy version.
    """
    order = Window.partitionBy("user_id").orderBy("day", "receipt_id")
    trips = d.receipt.select("receipt_id", F.lag("receipt_id").over(order).alias("list_id")).where("list_id is not null")
    named = d.sp.select("sp_id", "product_id", "category", names.significant_tokens(names.normal_name(F.col("name"))).alias("words"))
    lines = dealt(d.price.select("receipt_id", "id", "sp_id"), d.n_lines, "sp_id").join(named, "sp_id").drop("sp_id")
    # Each receipt's lines are gathered once, for what was bought and for the list of the next receipt.
    receipts = gathered(dealt(lines, d.n_lines, "receipt_id"), "receipt_id")
    planned = dealt(trips.join(receipts.withColumnRenamed("receipt_id", "list_id"), "list_id"), d.n_lines, "receipt_id").groupBy("receipt_id").agg(F.flatten(F.collect_list("lines")).alias("ours"))
    return paired_groups(planned.join(receipts.withColumnRenamed("lines", "theirs"), "receipt_id"), "receipt_id", UNASSIGNED)


@query("rec14_unit_prices", """
l AS (SELECT p.id, p.sp_id, p.store_id, p.price, p.quantity, s.amount, s.unit, s.weighable, s.product_id FROM price p JOIN sp s USING (sp_id)),
m AS (SELECT product_id, median(price / CASE WHEN unit IN ('g', 'ml') THEN amount / 1000 ELSE amount END) AS usual FROM l WHERE amount > 0 GROUP BY product_id)
SELECT l.id, l.sp_id, CASE WHEN l.unit IN ('l', 'ml') THEN 'l' WHEN l.unit IN ('kg', 'g') THEN 'kg' ELSE 'vnt' END AS unit, floor(l.price / CASE WHEN l.amount > 0 THEN CASE WHEN l.unit IN ('g', 'ml') THEN l.amount / 1000 ELSE l.amount END END * 100 + 0.5) / 100 AS unit_price, round(l.price / CASE WHEN l.unit IN ('g', 'ml') THEN l.amount / 1000 ELSE l.amount END / m.usual, 6) AS against_usual FROM l JOIN m USING (product_id) WHERE l.amount > 0""")
def rec14(d: Domain):
    """Price per litre, kilogram or piece of each line, and against the usual one of its product."""
    l = d.price.select("id", "sp_id", "price").join(d.sp.select("sp_id", "amount", "unit", "product_id"), "sp_id").where("amount > 0")
    per = F.col("price") / units.base_amount(F.col("amount"), F.col("unit"))
    usual = l.groupBy("product_id").agg(F.median(per).alias("usual"))
    shown = F.when(F.col("unit").isin("l", "ml"), "l").when(F.col("unit").isin("kg", "g"), "kg").otherwise("vnt")
    return l.join(usual, "product_id").select("id", "sp_id", shown.alias("unit"), units.money(per).alias("unit_price"), F.round(per / F.col("usual"), 6).alias("against_usual"))
