from pyspark.sql import functions as F

from pricewright.functions import names, scores, units
from pricewright.operators import graph, pricing, similarity, timeseries


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (3, 3), (16, 16), (20, 20), (15, 15), (9, 4)], "k int, n int")
    got = [r[0] for r in df.select(scores.wilson(F.col("k"), F.col("n"))).collect()]
    assert got[0] == 0 and got[1] < 0.8 and got[2] >= 0.8 and got[3] >= 0.8 and got[4] < 0.8 and got[5] <= 1


def test_units(spark):
    df = spark.createDataFrame([("kg",), ("ML",), ("vnt",), ("",), (None,)], "u string")
    assert [r[0] for r in df.select(units.family(F.col("u"))).collect()] == ["fluid", "fluid", "count", None, None]
    sizes = spark.createDataFrame([("cola 6x0,33 l",), ("sauce 250 g / 230 ml",), ("eggs 10 vnt",), ("bananas 1 kg",), ("bread",)], "t string")
    got = [tuple(r[0]) for r in sizes.select(units.parse_size(F.col("t"))).collect()]
    assert [(round(a, 3) if a else a, u, w) for a, u, w in got] == [(1.98, "l", False), (230.0, "ml", False), (10.0, "vnt", False), (1.0, "kg", True), (None, None, False)]


def test_money(spark):
    df = spark.createDataFrame([(1.005,), (-2.5,), (2.675,)], "x double")
    assert [r[0] for r in df.select(units.money(F.col("x"))).collect()] == [1.0, -2.5, 2.68]


def test_packs(spark):
    rows = [("a", 1, 30.0, 1.0, 10.0, False), ("a", 2, 30.0, 2.5, 30.0, False), ("b", 3, 5.0, 0.4, 4.0, False), ("b", 4, 5.0, 2.5, 30.0, False), ("c", 5, 0.25, 8.0, 1.0, True)]
    offers = spark.createDataFrame(rows, "item string, sp_id int, quantity double, eff double, amount double, weighable boolean")
    assert {r.item: (r.sp_id, r.total) for r in pricing.cheapest_for(offers, ["item"]).collect()} == {"a": (2, 2.5), "b": (3, 0.8), "c": (5, 2.0)}


def test_canonical_units(spark):
    rows = [(1, 0.33, "l", False), (1, 1.5, "l", False), (2, 36.0, "g", False), (3, 10.0, "vnt", False), (3, 6.0, "vnt", False), (3, 1.0, "kg", False), (4, 0.5, "kg", True), (4, 2.0, "kg", False)]
    got = {r.product_id: (r.family, r.unit, r.step) for r in pricing.canonical_units(spark.createDataFrame(rows, "product_id int, amount double, unit string, weighable boolean")).collect()}
    assert got == {1: ("fluid", "l", 0.5), 2: ("count", "vnt", 1.0), 3: ("count", "vnt", 6.0), 4: ("fluid", "kg", 0.1)}


def test_names(spark):
    df = spark.createDataFrame([("Pienas „Žemaitijos“ 2,5% 1 l", "ŠOKOLADAS")], "a string, b string")
    r = df.select(names.normal_name(F.col("a")), names.folded(F.col("b")), names.without_sizes(F.col("a")), F.size(names.trigrams(F.lit("ab")))).first()
    assert tuple(r) == ("pienas zemaitijos 2 5 1 l", "sokoladas", "pienas zemaitijos", 4)
    lane = df.select(similarity.token_lane(F.array(F.lit("pienas")), F.array(F.lit("pienai"), F.lit("x")))).first()[0]
    assert lane > 0.75


def test_distance_of_one_point(spark):
    one = F.lit(54.7)
    assert spark.range(1).select(scores.great_circle_km(one, one, one, one)).first()[0] == 0


def test_latest_and_components(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 7, "x"), (2, 1, "y")], "k int, id int, v string")
    assert sorted(map(tuple, timeseries.latest_by(df, ["k"], ["id"]).collect())) == [(1, 7, "x"), (2, 1, "y")]
    assert timeseries.latest_by(df.limit(0), ["k"], ["id"]).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    assert {r.node: r.root for r in graph.connected_classes(chain).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    forest = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)], "id int, parent int")
    assert {r.id: r.root for r in graph.effective_root(forest, 4).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}
