"""Gates, windows and places of the suggested baskets on a small table."""

import datetime

from pricewright.operators import previews

DAY = "2001-07-31"


def day(ago):
    return datetime.date(2001, 7, 31) - datetime.timedelta(days=ago)


def frames(spark, bought, seen=None):
    receipts = [(u, 100 * u + i, c) for u, chains in {1: [1, 2, 1], 2: [1, 1, 1], 3: [1, 2], 4: [1, None, 1], 5: [3, 4, 4]}.items() for i, c in enumerate(chains)]
    products = [(p, "dairy" if p < 20 else "bread" if p < 30 else None, p == 11) for p in range(10, 40)]
    return (
        spark.createDataFrame(receipts, "user_id long, receipt_id long, chain_id int"), spark.createDataFrame(bought, "user_id long, day date, product_id long, quantity double"),
        spark.createDataFrame(products, "product_id long, category string, weighable boolean"), spark.createDataFrame(seen or sorted({(p, d) for _, d, p, _ in bought}), "product_id long, day date"),
    )


def test_gates(spark):
    got = {r.user_id: (r.receipts, r.chains, r.qualified) for r in previews.gates(frames(spark, [(1, day(0), 10, 1.0)])[0]).collect()}
    assert got == {1: (3, 2, True), 2: (3, 1, False), 3: (2, 2, False), 4: (3, 1, False), 5: (3, 2, True)}


def test_window_widens(spark):
    rows = [(u, day(3), 10, 1.0) for u in (1, 2, 3, 4)] + [(1, day(3), 11, 1.0), (9, day(14), 10, 1.0), (9, day(-1), 10, 1.0)]
    assert previews.global_window(frames(spark, rows)[1], DAY) == 90
    assert previews.global_window(frames(spark, [*rows, (5, day(13), 10, 1.0)])[1], DAY) == 14


def test_places(spark):
    bought = [
        (1, day(1), 10, 2.0), (1, day(1), 11, 0.26), (1, day(50), 10, 4.0), (1, day(95), 12, 1.0), (1, day(70), 15, 3.0),  # 12 is out of the window, 15 hasn't been seen lately
        (5, day(2), 20, 1.0), (5, day(-1), 21, 9.0),  # the future doesn't count
        (2, day(1), 13, 6.0), (2, day(1), 14, 1.0), (2, day(2), 16, 1.0), (2, day(2), 13, 8.0), (3, day(3), 10, 1.0), (3, day(4), 30, 1.0), (2, day(5), 22, 0.0), (2, day(6), 30, 1.0),
    ]
    got = sorted((r.user_id, r.place, r.product_id, r.source, r.quantity) for r in previews.previews(*frames(spark, bought), DAY).collect())
    # User 1: both sides know 10 and 11, then by score: their own 15 (its place stays empty), and two of what others buy of dairy.
    assert [x[1:] for x in got if x[0] == 1] == [(1, 10, "both", 3.0), (2, 11, "both", 0.3), (3, 13, "global", 7.0), (5, 14, "global", 1.0)]
    assert [x[2:] for x in got if x[0] == 5] == [(20, "both", 1.0), (22, "global", 1.0)]
    assert {x[0] for x in got} == {1, 5}
    assert previews.previews(*(f.limit(0) for f in frames(spark, bought)), DAY).count() == 0
