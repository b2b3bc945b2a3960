"""Queries over groups that grow with the tables: the rows that meet inside them must not."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewright.functions import recipe_units
from pricewright.operators import dealing, lexicon, minting, nearby, packed
from pricewright.plans import catalog, prices, pricing, registry, resolution
from pricewright.sources.domain import Domain


class Views(Domain):
    """A domain whose views are given."""

    def __init__(self, spark, **views):
        super().__init__(spark, "")
        self.__dict__.update(views)


def joined_rows(df):
    """The most rows that any operator of the finished plan made."""
    df.collect()
    text, most = [df._jdf.queryExecution().executedPlan()], 0
    while text:
        node = text.pop()
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            text.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            text.append(node.plan())
        children = node.children()
        text += [children.apply(i) for i in range(children.size())]
    return most


def tasks_of(df):
    """Tasks of the last stage once the plan is finished."""
    df.collect()
    return df.rdd.getNumPartitions()


def prices_of(spark, rows):
    return spark.createDataFrame(rows, "id long, sp_id long, receipt_id long, quantity double, price double, day string").withColumn("day", F.col("day").cast("date"))


def test_price_band_of_one_price(spark):
    rows = [(i, i, i, 1.0, 2.0, "2000-01-01") for i in range(400)] + [(1000, 7, 1, 1.0, 2.25, "2000-01-20"), (1001, 9, 1, 1.0, 2.0, "2000-03-01")]
    found = prices.join09(Views(spark, price=prices_of(spark, rows)))
    got = {}
    for r in found.collect():
        got.setdefault(r.line_id, []).append((r.distance, r.sp_id))
    assert sorted(got[5]) == [(0.0, i) for i in range(5)] and sorted(got[1000]) == [(0.0, 7), *((0.25, i) for i in range(4))] and got[1001] == [(0.0, 9)]
    assert joined_rows(found) < 5000


def test_wildcards_among_many_equal_products(spark):
    rows = [(i, "Ring", "B", 1.0 + i % 2, "kg") for i in range(10, 410)] + [(500, "ring", "B", 9.0, "pak"), (501, "ring", "B", None, "kg"), (502, "ring", None, 1.0, "kg"), (503, "ring", "C", None, "kg")]
    found = catalog.rm03(Views(spark, sp=spark.createDataFrame(rows, "sp_id long, name string, brand string, amount double, unit string")))
    got = {r.sp_id: r.found for r in found.collect()}
    assert got == {i: 10 + i % 2 for i in range(10, 410)} | {500: 10, 501: 500}
    assert joined_rows(found) < 1000


@pytest.mark.parametrize("lines", [40])
def test_comparison_of_long_receipts(spark, lines):
    stores = spark.createDataFrame([(s, s) for s in range(25)], "store_id long, chain_id int")
    rows = [(r * 100 + i, i, r, 2.0, 1.0 + r, "2000-01-01", i % 25) for r in range(3) for i in range(lines)]
    columns = "id long, sp_id long, receipt_id long, quantity double, price double, day string, store_id long"
    price = spark.createDataFrame(rows, columns).withColumns({"day": F.col("day").cast("date"), "promo_price": F.lit(None).cast("double"), "valid_from": F.lit(None).cast("timestamp_ntz"), "promo_end": F.lit(None).cast("timestamp_ntz")})
    found = pricing.opt08(Views(spark, price=price, store=stores))
    got = found.collect()
    assert len(got) == 75 and {(r.lines, r.total) for r in got} == {(lines, lines * 2 * 3.0)}
    assert {r.chain_id: r.known for r in got} == {c: len(range(c, lines, 25)) for c in range(25)}
    assert joined_rows(found) < 25 * lines * 3


def test_chain_candidates_are_the_least_of_equals(spark):
    rows = [(i, "red ring", 1.0, "kg", False, "SMALL") for i in range(40)] + [(i, "red ring", None, None, False, "PROMO") for i in range(40, 60)]
    cat = spark.createDataFrame(rows, "sp_id long, name string, amount double, unit string, weighable boolean, category string")
    sold = spark.createDataFrame([(i, c) for i in range(60) for c in (1, 2) if (i + c) % 3], "sp_id long, chain_id int")
    got = resolution.chain_candidates(spark.createDataFrame([(1,), (2,)], "chain_id int"), cat, sold).collect()
    for chain in (1, 2):
        own = lambda i: (i + chain) % 3 != 0
        want = [i for i in range(40) if own(i)][:2] + [i for i in range(40) if not own(i)][:4] + [i for i in range(40, 60) if own(i)][:2]
        assert sorted(r.sp_id for r in got if r.chain_id == chain) == sorted(want)


def test_as_of_a_receipt_with_many_prices(spark):
    rows = [(i, 1, i // 2, "2000-01-01", i % 4 == 0, float(i)) for i in range(400)] + [(900, 1, 900, "1999-01-01", True, 5.0), (901, 2, 901, "1999-01-01", False, 5.0)]
    price = spark.createDataFrame(rows, "id long, sp_id long, receipt_id long, day string, is_fallback boolean, price double").withColumn("day", F.col("day").cast("date"))
    receipt = spark.createDataFrame([(r, "2000-01-02" if r < 900 else "1999-06-01") for r in [*range(200), 900, 901]], "receipt_id long, day string").withColumn("day", F.col("day").cast("date"))
    found = prices.ts09(Views(spark, price=price, receipt=receipt))
    got = {r.left_id: r.id for r in found.collect()}
    assert got == {r: max(i for i in range(400) if i // 2 != r and i % 4) for r in range(200)}
    assert joined_rows(found) < 2000


def test_propagation_moves_no_row_for_every_store(spark):
    store = spark.createDataFrame([(s, 1) for s in range(500)], "store_id long, chain_id int")
    rows = [(p, p, p % 7, 2.0, "2001-11-01", True, True) for p in range(40)] + [(100, 3, 9, 1.0, "2001-11-02", True, False), (101, 4, 9, 1.0, "2001-10-16", False, False), (102, 5, 9, 1.0, "2001-10-01", True, False)]
    price = spark.createDataFrame(rows, "id long, sp_id long, store_id long, price double, day string, is_fallback boolean, verified boolean").withColumn("day", F.col("day").cast("date"))
    found = prices.ts16(Views(spark, price=price, store=store))
    got = found.collect()
    assert len(got) == 40 * 499 and {(r.sp_id, r.store_id): r.action for r in got if r.action != "insert"} == {(3, 9): "keep", (4, 9): "keep", (5, 9): "update"}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("Generate inline")[0].split("== Initial")[0]


def test_units_in_any_words(spark):
    words = spark.createDataFrame([("2 arbatiniai šaukšteliai ir kg cukraus kg x",), ("",), (None,)], "text string")
    found = words.select(F.explode(recipe_units.named_runs(F.split(recipe_units.unit_key(F.col("text")), " "))).alias("run"))
    assert sorted(r.run for r in found.collect()) == ["arbatiniai saukšteliai".replace("š", "s"), "kg", "kg", "saukšteliai".replace("š", "s")]


def test_products_are_not_gathered_by_file_size(spark, sf_dir):
    d = Domain(spark, sf_dir)
    assert "SortMergeJoin" in d.price.join(d.sp, "sp_id")._jdf.queryExecution().executedPlan().toString()


def test_runs_without_hits_stay_where_they_are(spark):
    phrases = spark.createDataFrame([(1, "a b c " * 50 + "red onion")], "id long, phrase string")
    words = spark.createDataFrame([("onion", "red onions", "en", 1)], "key string, form string, lang string, place int")
    found = lexicon.lexicon_hits(phrases, words)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.form, r["at"], r.exact) for r in lexicon.lexicon_hits(phrases, words.withColumn("form", F.lit("red onion"))).collect()] == [("red onion", 150, True)]


def test_twins_meet_by_profile(spark):
    catalog_rows = [(i, i, 1, "red ring", "", 1.0, "kg", False) for i in range(300)] + [(1000 + i, 1000 + i, 2, "red ring", "", 1.0, "kg", False) for i in range(300)]
    listed = spark.createDataFrame(catalog_rows, "sp_id long, product_id long, chain_id int, name string, brand string, amount double, unit string, weighable boolean")
    confirms = spark.createDataFrame([(1, 1000 + i, 5, i) for i in range(300)], "chain_id int, source_id long, user_id long, confirm_id long")
    found = minting.minted(confirms, listed, spark.createDataFrame([], "sp_id long, chain_id int, source_id long"))
    assert {(r.outcome, r.sp_id, r.twin_product) for r in found.collect()} == {("twin", 0, 0)} and found.count() == 300
    assert joined_rows(found) < 2000


@pytest.fixture
def many_lines(spark, sf_dir, monkeypatch):
    """The small tables, where a task is meant to hold a hundred lines."""
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 100)
    return Domain(spark, sf_dir)


@pytest.mark.parametrize("name", ["rm26_candidate_upsert", "rm19_candidate_details", "opt15_savings_against_market", "rec02_trip_probability", "join13_list_and_receipt"])
def test_tasks_grow_in_number_and_not_in_size(many_lines, name):
    """6,000 lines at a hundred a task: Spark by itself packs them into as few tasks as there are cores."""
    assert tasks_of(registry.QUERIES[name][0](many_lines)) >= 60


def test_price_band_of_close_prices(spark, monkeypatch):
    """Lines whose prices and days all differ but lie close: no pair of them is a row, though everybody's neighbours are many."""
    monkeypatch.setattr(nearby, "PAIRS_AT_ONCE", 500)
    rows = [(i, i * 7919 % 1000, i, 1.0, (i * 37 % 1800) / 100 + 7.0, f"2000-0{1 + i % 4}-{1 + i % 28:02}") for i in range(1500)]
    rows += [(5000, None, 1, 1.0, 8.0, "2000-01-01"), (None, 3, 1, 1.0, 8.0, "2000-01-01"), (5002, 4, 1, 1.0, None, "2000-01-01"), (5003, 4, 1, 1.0, 8.0, None), rows[0], (5004, 9, 1, 1.0, 500.0, "1969-12-20")]
    price = prices_of(spark, rows)
    found = prices.join09(Views(spark, price=price))
    con = duckdb.connect()
    con.register("price", price.toPandas().assign(day=lambda x: pd.to_datetime(x.day)).convert_dtypes())
    want = con.execute("WITH price AS (SELECT id, sp_id, price, CAST(day AS DATE) AS day FROM main.price), " + registry.QUERIES["join09_price_band"][1].strip()).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key) and len(want) > 7000
    assert joined_rows(found) < 12_000


def test_packed_numbers(spark):
    cases = [(0,), (1, 0, 1), tuple(range(40)), (2**62, 5, 2**63 - 1), (2**21 - 1,) * 7, ()]
    df = spark.createDataFrame([(list(v),) for v in cases], "v array<long>").withColumn("w", packed.bits(F.coalesce(F.array_max("v"), F.lit(0).cast("long"))))
    df = df.withColumn("p", F.concat(F.array(F.lit(-7).cast("long")), packed.packed(F.col("v"), F.col("w")))).withColumn("n", packed.longs(F.size("v"), F.col("w")))
    for r in df.select("*", F.transform("v", lambda x: packed.unpacked(F.col("p"), F.lit(1), (F.array_position("v", x) - 1).cast("int"), F.col("w"))).alias("back")).collect():
        assert r.back == r.v and len(r.p) == r.n + 1 == 1 + -(-len(r.v) // (63 // r.w))


def test_comparison_moves_little_with_a_line(spark):
    """Forty chains offer everything; some prices, stores' chains and products are unknown."""
    stores = spark.createDataFrame([(s, 1000 + 7 * s if s < 40 else None) for s in range(42)], "store_id long, chain_id int")
    rows = [(i, i % 50 if i % 97 else None, i % 400, float(1 + i % 3), (i * 37 % 5000) / 100 if i % 101 else None, "2001-11-0" + str(1 + i % 5), i * 31 % 43) for i in range(4000)]
    columns = "id long, sp_id long, receipt_id long, quantity double, price double, day string, store_id long"
    promo = F.when(F.col("id") % 4 == 0, F.col("price") / 2).alias("promo_price")
    price = spark.createDataFrame(rows, columns).withColumns({"day": F.col("day").cast("date"), "promo_price": F.floor(promo * 100) / 100})
    price = price.withColumns({"valid_from": F.col("day").cast("timestamp_ntz"), "promo_end": (F.col("day") + F.expr("INTERVAL 2 DAYS")).cast("timestamp_ntz")})
    found = pricing.opt08(Views(spark, price=price, store=stores))
    con = duckdb.connect()
    con.register("p", price.withColumns({x: F.col(x).cast("string") for x in ("day", "valid_from", "promo_end")}).toPandas().convert_dtypes())
    con.register("s", stores.toPandas().convert_dtypes())
    views = "WITH price AS (SELECT * REPLACE (CAST(day AS DATE) AS day, CAST(valid_from AS TIMESTAMP) AS valid_from, CAST(promo_end AS TIMESTAMP) AS promo_end) FROM p), store AS (FROM s), "
    want = con.execute(views + registry.QUERIES["opt08_receipt_comparison"][1].strip()).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    rounded = lambda rows: sorted(((*r[:4], None if r[4] is None else round(r[4], 6)) for r in map(tuple, rows)), key=key)
    assert rounded(found.collect()) == rounded(want) and len(want) > 10_000
    assert row_bytes(found) < 250


def row_bytes(df):
    """The mean size of rows in the finished plan's widest exchange."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name, children = node.nodeName(), node.children()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        elif name == "Exchange":
            most = max(most, node.metrics().apply("dataSize").value() / max(1, node.metrics().apply("shuffleRecordsWritten").value()))
        todo += [children.apply(i) for i in range(children.size())]
    return most
