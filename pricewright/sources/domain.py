"""Domain views over the supplied star-schema tables.

Each view is a projection (at most one join with a dimension) of a table, given as SQL expressions
that both Spark and the checking SQL read, so that both sides see the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Everything is judged at this moment, never at the clock's.
AS_OF = "2001-11-05"

PRICE = "floor(l_extendedprice / l_quantity * 100 + 0.5) / 100"

STORE_PRODUCT = [
    "p_partkey AS sp_id", "p_name AS name", "p_brand AS brand", "CAST(p_size AS DOUBLE) AS amount",
    "CASE p_partkey % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' WHEN 2 THEN 'l' WHEN 3 THEN 'ml' WHEN 4 THEN 'vnt' ELSE 'pak' END AS unit",
    "(p_partkey % 5 = 0 AND p_partkey % 6 IN (0, 2)) AS weighable", "p_type AS category",
    "CAST(floor(p_partkey / 4) AS BIGINT) AS product_id", "p_retailprice AS list_price",
]
PRICES = [
    "l_orderkey * 16 + l_linenumber AS id", "l_partkey AS sp_id", "l_suppkey AS store_id", f"{PRICE} AS price",
    f"CASE WHEN l_discount > 0 THEN floor({PRICE} * (1 - l_discount) * 100 + 0.5) / 100 END AS promo_price",
    "l_shipdate AS valid_from", "CASE WHEN l_linenumber <> 7 THEN l_shipdate + INTERVAL 14 DAY END AS promo_end",
    "CAST(l_shipdate AS DATE) AS day", "l_linestatus = 'F' AS is_fallback", "l_returnflag = 'A' AS verified",
    "l_orderkey AS receipt_id", "l_linenumber AS line_no", "l_quantity AS quantity",
]
STORES = [
    "s_suppkey AS store_id", "s_name AS name", "s_nationkey AS chain_id",
    "54 + ((s_suppkey * 37) % 200) / 100.0D AS lat", "21 + ((s_suppkey * 53) % 500) / 100.0D AS lng",
]
RECEIPTS = [
    "o_orderkey AS receipt_id", "o_custkey AS user_id", "CAST(o_orderdate AS DATE) AS day", "o_orderstatus AS status",
    "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents", "o_orderpriority AS priority",
]
VOTES = [
    "l_partkey AS sp_a", "l_suppkey + 100000 AS sp_b", "l_orderkey % 500 AS user_id",
    "CASE l_returnflag WHEN 'A' THEN 'identical' WHEN 'N' THEN 'similar' ELSE 'different' END AS vote",
    "l_orderkey * 16 + l_linenumber AS vote_id", "CAST(l_shipdate AS DATE) AS day", "CAST(l_quantity * 40 AS INT) AS dwell_ms",
]
INTERACTIONS = [
    "event_id", "ts", "user_id",
    "CASE event_type WHEN 'purchase' THEN 'receipt_buy' WHEN 'click' THEN 'list_check' WHEN 'view' THEN 'basket_add' WHEN 'signup' THEN 'list_add' END AS type",
    "value",
]


class Domain:
    """The views of one data folder; each is read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def sp(self) -> DataFrame:
        # Few names and brands pack into small files, so that Spark's size check would gather millions of products in the driver.
        return self.table("part").selectExpr(*STORE_PRODUCT).hint("merge")

    @cached_property
    def price(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*PRICES)

    @cached_property
    def n_lines(self) -> int:
        """How many receipt lines there are; file footers tell."""
        return self.price.count()

    @cached_property
    def store(self) -> DataFrame:
        return self.table("supplier").selectExpr(*STORES)

    @cached_property
    def chain(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS chain_id", "n_name AS chain", "n_regionkey AS zone_id")

    @cached_property
    def receipt(self) -> DataFrame:
        return self.table("orders").selectExpr(*RECEIPTS)

    @cached_property
    def user(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS user_id", "c_name AS name", "CAST(floor(c_custkey / 4) AS BIGINT) AS household_id", "c_acctbal AS balance", "c_mktsegment AS segment")

    @cached_property
    def vote(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*VOTES)

    @cached_property
    def interaction(self) -> DataFrame:
        product = "CAST(get_json_object(props, '$.k') AS BIGINT) AS product_id"
        return self.table("events").selectExpr(*INTERACTIONS, product).where("type IS NOT NULL")


def checking_views() -> str:
    """The same views as common table expressions for the checking SQL."""
    plain = lambda x: ", ".join(x).replace("100.0D", "100.0::DOUBLE")
    return f"""
sp AS (SELECT {plain(STORE_PRODUCT)} FROM part),
price AS (SELECT {plain(PRICES)} FROM lineitem),
store AS (SELECT {plain(STORES)} FROM supplier),
chain AS (SELECT n_nationkey AS chain_id, n_name AS chain, n_regionkey AS zone_id FROM nation),
receipt AS (SELECT {plain(RECEIPTS)} FROM orders),
person AS (SELECT c_custkey AS user_id, c_name AS name, CAST(floor(c_custkey / 4) AS BIGINT) AS household_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer),
vote AS (SELECT {plain(VOTES)} FROM lineitem),
interaction AS (SELECT * FROM (SELECT {plain(INTERACTIONS)}, CAST(props->>'$.k' AS BIGINT) AS product_id FROM events) WHERE type IS NOT NULL)"""
