"""Queries over votes, links and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricewright.functions import scores
from pricewright.operators.graph import connected_classes, effective_root
from pricewright.plans.registry import query
from pricewright.sources.domain import Domain

LAST_VOTE_SQL = "last_vote AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY user_id, sp_a, sp_b ORDER BY day DESC, vote_id DESC, vote DESC) = 1)"
TALLY_SQL = LAST_VOTE_SQL + ", tally AS (SELECT sp_a, sp_b, count(*) FILTER (vote = 'identical') AS identical, count(*) FILTER (vote = 'similar') AS alike, count(*) FILTER (vote = 'different') AS different FROM last_vote GROUP BY ALL)"
WILSON_SQL = "CASE WHEN n <= 0 THEN 0 ELSE greatest(0, (k::DOUBLE / n + 1.96 * 1.96 / (2 * n::DOUBLE) - 1.96 * sqrt((k::DOUBLE / n * (1 - k::DOUBLE / n) + 1.96 * 1.96 / (4 * n::DOUBLE)) / n)) / (1 + 1.96 * 1.96 / n)) END"


def last_votes(d: Domain):
    """One vote per user and pair, the last one."""
    return d.vote.groupBy("user_id", "sp_a", "sp_b").agg(F.max(F.struct("day", "vote_id", "vote"))["vote"].alias("vote"))


def tallies(d: Domain):
    of = lambda v, name=None: F.count(F.when(F.col("vote") == v, 1)).alias(name or v)
    return last_votes(d).groupBy("sp_a", "sp_b").agg(of("identical"), of("similar", "alike"), of("different"))


@query("con01_vote_tallies", TALLY_SQL + " SELECT * FROM tally")
def con01(d: Domain):
    return tallies(d)


@query("mth01_wilson_bounds", LAST_VOTE_SQL + f", t AS (SELECT sp_a, count(*) FILTER (vote = 'identical') AS k, count(*) AS n FROM last_vote GROUP BY sp_a) SELECT sp_a, round({WILSON_SQL}, 8) AS bound FROM t")
def mth01(d: Domain):
    t = last_votes(d).groupBy("sp_a").agg(F.count(F.when(F.col("vote") == "identical", 1)).alias("k"), F.count("*").alias("n"))
    return t.select("sp_a", F.round(scores.wilson(F.col("k"), F.col("n")), 8).alias("bound"))


@query("con02_counted_votes", """
SELECT vote, count(*) AS votes, count(*) FILTER (dwell_ms >= 100) AS kept, count(*) FILTER (dwell_ms >= 700) AS orphan, count(*) FILTER (dwell_ms >= 1000) AS counted FROM vote GROUP BY vote""")
def con02(d: Domain):
    at_least = lambda ms, name: F.count(F.when(F.col("dwell_ms") >= ms, 1)).alias(name)
    return d.vote.groupBy("vote").agg(F.count("*").alias("votes"), at_least(100, "kept"), at_least(700, "orphan"), at_least(1000, "counted"))


@query("con02_rate_limit", """
SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS votes FROM vote GROUP BY user_id, day HAVING count(*) > 2""")
def con02_rate(d: Domain):
    return d.vote.groupBy("user_id", "day").agg(F.count("*").alias("votes")).where("votes > 2").select("user_id", F.col("day").cast("string").alias("day"), "votes")


def merge_decisions(tally, least_votes: int = 3, promote: float = 0.80, demote: float = 0.50):
    """decision for each pair: ``promote`` or ``demote`` if its identical votes are enough and their share's lower bound is high or low, else ``hold``.

    ``tally`` has sp_a, sp_b, identical, alike and different; a pair without votes is held.
    """
    bound = scores.wilson(F.col("identical"), F.col("identical") + F.col("alike") + F.col("different"))
    enough = F.col("identical") >= least_votes
    return tally.select("sp_a", "sp_b", F.when(enough & (bound >= promote), "promote").when(enough & (bound <= demote), "demote").otherwise("hold").alias("decision"))


@query("con03_merge_decisions", TALLY_SQL + f""",
t AS (SELECT sp_a, sp_b, identical AS k, identical + alike + different AS n FROM tally),
w AS (SELECT sp_a, sp_b, k, {WILSON_SQL} AS bound FROM t)
SELECT sp_a, sp_b, CASE WHEN k >= 3 AND bound >= 0.80 THEN 'promote' WHEN k >= 3 AND bound <= 0.50 THEN 'demote' ELSE 'hold' END AS decision FROM w""")
def con03(d: Domain):
    """Each pair by its own votes; few pairs of the small tables have enough, so a test gives some."""
    return merge_decisions(tallies(d))


@query("con04_merge_winner", """
SELECT product_id, sp_id AS winner, name FROM sp QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY length(name), sp_id) = 1""")
def con04(d: Domain):
    best = d.sp.groupBy("product_id").agg(F.min(F.struct(F.length("name").alias("n"), "sp_id", "name")).alias("w"))
    return best.select("product_id", F.col("w.sp_id").alias("winner"), "w.name")


@query("con15_admin_merge_winner", "SELECT product_id, sp_id AS winner FROM sp QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY list_price DESC, sp_id) = 1")
def con15(d: Domain):
    return d.sp.groupBy("product_id").agg(F.max_by("sp_id", F.struct("list_price", -F.col("sp_id"))).alias("winner"))


@query("con06_effective_root", """
node AS (SELECT sp_id AS id, CASE WHEN sp_id % 7 = 0 AND sp_id > 0 THEN sp_id // 3 END AS parent FROM sp),
walk AS (SELECT id, id AS root, 0 AS depth FROM node UNION ALL SELECT w.id, n.parent, w.depth + 1 FROM walk w JOIN node n ON n.id = w.root WHERE n.parent IS NOT NULL AND w.depth < 4)
SELECT id, root FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1""")
def con06(d: Domain):
    return effective_root(d.sp.select(F.col("sp_id").alias("id"), F.expr("CASE WHEN sp_id % 7 = 0 AND sp_id > 0 THEN sp_id div 3 END").alias("parent")), 4)


@query("con07_linked_sets")
def con07(d: Domain):
    """Over all identical votes; a test holds it against a union-find."""
    return connected_classes(d.vote.where("vote = 'identical'").select(F.col("sp_a").alias("a"), F.col("sp_b").alias("b")).distinct())


@query("con10_alias_states", TALLY_SQL + """
SELECT sp_a, sp_b, CASE WHEN sp_a % 100 = 0 THEN 'admin' WHEN different > 0 AND different >= identical THEN 'rejected' WHEN identical >= 2 THEN 'alias' WHEN alike > 0 THEN 'similar' ELSE 'pending' END AS state FROM tally""")
def con10(d: Domain):
    state = F.when(F.col("sp_a") % 100 == 0, "admin").when((F.col("different") > 0) & (F.col("different") >= F.col("identical")), "rejected").when(F.col("identical") >= 2, "alias").when(F.col("alike") > 0, "similar").otherwise("pending")
    return tallies(d).select("sp_a", "sp_b", state.alias("state"))


@query("agg17_alias_vote_users", """
SELECT sp_a, count(DISTINCT CASE WHEN vote = 'identical' THEN user_id END) AS identical, count(DISTINCT CASE WHEN vote = 'similar' THEN user_id END) AS alike, count(DISTINCT CASE WHEN vote = 'different' THEN user_id END) AS different FROM vote GROUP BY sp_a""")
def agg17(d: Domain):
    of = lambda v, name=None: F.count(F.when(F.col("vote") == v, 1)).alias(name or v)
    return d.vote.groupBy("sp_a", "vote", "user_id").agg(F.lit(1).alias("one")).groupBy("sp_a").agg(of("identical"), of("similar", "alike"), of("different"))


@query("con11_base_link_counter", """
SELECT least(sp_a, sp_b) AS a, greatest(sp_a, sp_b) AS b, greatest(0, sum(CASE vote WHEN 'similar' THEN 1 WHEN 'different' THEN -1 ELSE 0 END))::BIGINT AS n FROM vote GROUP BY ALL""")
def con11(d: Domain):
    delta = F.when(F.col("vote") == "similar", 1).when(F.col("vote") == "different", -1).otherwise(0)
    return d.vote.groupBy(F.least("sp_a", "sp_b").alias("a"), F.greatest("sp_a", "sp_b").alias("b")).agg(F.greatest(F.lit(0), F.sum(delta)).cast("long").alias("n"))


@query("con12_category_subtree", """
tree AS (SELECT 'r' || zone_id AS id, NULL AS parent FROM chain GROUP BY zone_id UNION SELECT 'n' || chain_id, 'r' || zone_id FROM chain UNION SELECT 's' || store_id, 'n' || chain_id FROM store),
walk AS (SELECT id AS top, id, 0 AS depth FROM tree UNION ALL SELECT w.top, t.id, w.depth + 1 FROM walk w JOIN tree t ON t.parent = w.id)
SELECT top, count(*) AS members, max(depth)::INT AS depth FROM walk GROUP BY top""")
def con12(d: Domain):
    root = d.chain.select(F.concat(F.lit("r"), "zone_id").alias("id"), F.lit(None).cast("string").alias("parent")).distinct()
    tree = root.unionByName(d.chain.select(F.concat(F.lit("n"), "chain_id").alias("id"), F.concat(F.lit("r"), "zone_id").alias("parent"))).unionByName(d.store.select(F.concat(F.lit("s"), "store_id").alias("id"), F.concat(F.lit("n"), "chain_id").alias("parent")))
    up = tree.select(F.col("id").alias("node"), F.col("parent").alias("above"))
    level = tree.select("id", F.col("id").alias("top"), F.lit(0).alias("depth"))
    out = level
    for depth in (1, 2):  # the tree has three levels
        level = level.join(up, level["top"] == up["node"]).where("above is not null").select("id", F.col("above").alias("top"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out.groupBy("top").agg(F.count("*").alias("members"), F.max("depth").alias("depth"))


@query("set03_unvoted_pairs", """
SELECT count(*) AS pairs FROM (SELECT DISTINCT l_partkey AS a, l_suppkey + 100000 AS b FROM lineitem WHERE l_linenumber = 1) x
WHERE NOT EXISTS (SELECT 1 FROM vote v WHERE v.sp_a = x.a AND v.sp_b = x.b AND v.vote = 'different')""")
def set03(d: Domain):
    pairs = d.table("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("sp_a"), (F.col("l_suppkey") + 100000).alias("sp_b")).distinct()
    return pairs.join(d.vote.where("vote = 'different'"), ["sp_a", "sp_b"], "left_anti").agg(F.count("*").alias("pairs"))


@query("er17_queue_of_pairs", TALLY_SQL + """
SELECT sp_a, sp_b, identical + alike + different AS votes, identical > 0 AND different > 0 AS conflict FROM tally
QUALIFY row_number() OVER (PARTITION BY sp_a ORDER BY (identical > 0 AND different > 0) DESC, identical + alike + different DESC, sp_b) <= 3""")
def er17(d: Domain):
    t = tallies(d).select("sp_a", "sp_b", (F.col("identical") + F.col("alike") + F.col("different")).alias("votes"), ((F.col("identical") > 0) & (F.col("different") > 0)).alias("conflict"))
    order = Window.partitionBy("sp_a").orderBy(F.desc("conflict"), F.desc("votes"), "sp_b")
    return t.withColumn("rn", F.row_number().over(order)).where("rn <= 3").drop("rn")
