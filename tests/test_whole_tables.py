"""Operators that SQL can't check over whole tables, or of which the tables show little."""

from pricewright.operators import pricing
from pricewright.plans import consensus, matching, registry, worklists
from pricewright.sources.domain import Domain


def test_linked_sets_against_union_find(spark, sf_dir):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    votes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'A'").selectExpr("l_partkey", "l_suppkey + 100000").collect()
    for a, b in votes:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in registry.queries()["con07_linked_sets"](spark, sf_dir).collect()}
    assert len(got) > 100 and got == {x: find(x) for x in root}


def test_recovery_matches(spark):
    rows = [(u, f"2001-01-0{i}", 10_000 * i + {1: 0, 2: 50, 3: 51, 4: -50}.get(u, 7000 * u), i % 2) for i in range(1, 5) for u in range(1, 9)]
    rows += [(9, "2001-01-01", 10_000, 1), (9, "2001-01-02", 20_000, 2)]
    rows += [(u, f"2002-01-0{i}", 10_000 * i, 7 if i < 5 else None) for i in range(1, 6) for u in (20, 21)]  # one chain, and an unknown one
    found = matching.recovery_matches(spark.createDataFrame(rows, "user_id long, day string, cents long, chain_id int")).collect()
    near = {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a != b and {a, b} in ({1, 2}, {1, 4}, {2, 3})}
    assert {(r.claimed, r.candidate): (r.receipts, r.chains) for r in found} == dict.fromkeys(near, (4, 2))


def test_merge_decisions(spark):
    rows = [(1, 2, 20, 0, 0), (1, 3, 3, 0, 0), (2, 3, 3, 0, 17), (4, 5, 2, 0, 18), (5, 6, 0, 0, 0), (6, 7, 16, 0, 0), (7, 8, 12, 1, 0)]
    got = {(r.sp_a, r.sp_b): r.decision for r in consensus.merge_decisions(spark.createDataFrame(rows, "sp_a int, sp_b int, identical int, alike int, different int")).collect()}
    assert got == {(1, 2): "promote", (1, 3): "demote", (2, 3): "demote", (4, 5): "hold", (5, 6): "hold", (6, 7): "promote", (7, 8): "hold"}


def test_real_discount(spark):
    rows = [(1, 1, 4.0), (1, 1, 9.0), (1, 2, 6.0), (2, 1, 1.0), (2, 2, 5.01), (3, 1, 2.0), (4, 1, 1.0), (4, 2, 5.0)]
    offers = spark.createDataFrame(rows, "product_id long, chain_id long, unit_price double")
    assert sorted(map(tuple, pricing.real_discount(offers).collect())) == [(1, 2, 4.0, 20), (4, 2, 1.0, 67)]
    assert {r.product_id for r in pricing.real_discount(offers, 6).collect()} == {1, 2, 4}


def test_substitutes(spark, sf_dir):
    rows = [(1, "red wool hat", "wear", "vnt", 1), (2, "red hat", "wear", "vnt", 1), (3, "red wool cap", "wear", "pak", 2), (4, "wool hat red", "wear", "vnt", 3), (5, "red sock", "wear", "vnt", 4), (6, "red wool hat", "toys", "vnt", 5), (7, "red wool hat", "wear", "kg", 6)]
    catalog = spark.createDataFrame(rows, "sp_id long, name string, category string, unit string, product_id long")
    items = spark.createDataFrame([(1,)], "item_id long")
    assert sorted(map(tuple, pricing.substitutes(items, catalog).collect())) == [(1, 3, 0.666667), (1, 4, 1.0)]
    assert [r.sp_id for r in pricing.substitutes(items, catalog, most=1).collect()] == [4]
    totals = registry.queries()["opt01_basket_over_stores"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_substituted for r in totals) > 0


def test_resumable_baskets(spark):
    """Drafts of the last two days only; the older ones still count as active or abandoned."""
    receipts = [(1, 1, "2001-11-03", "O"), (2, 1, "2001-11-02", "O"), (3, 2, "2001-11-02", "O"), (4, 2, "1999-01-01", "O"), (5, 3, "2001-11-05", "P"), (6, 3, "2001-11-05", "F"), (7, 4, "2001-11-04", "O"), (8, 4, "2001-11-04", "O")]
    d = Domain(spark, "")
    d.__dict__["receipt"] = spark.createDataFrame(receipts, "receipt_id long, user_id long, day string, status string").selectExpr("receipt_id", "user_id", "CAST(day AS DATE) AS day", "status")
    d.__dict__["price"] = spark.createDataFrame([(2, True), (2, False), (3, False), (4, True), (6, True)], "receipt_id long, verified boolean")
    got = {r.user_id: (r.active, r.draft, r.abandoned) for r in worklists.rm09(d).collect()}
    assert got == {1: (2, 1, 1), 2: (4, None, 1), 3: (None, None, 1), 4: (None, 8, 2)}
