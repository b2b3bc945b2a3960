"""Receipt lines and scraped offers against a small catalog: every gate has a row that passes and one that doesn't."""

import pytest

from pricewright.operators import lines, upserts

LINE = "line_id long, chain_id int, sp_id long, confidence double, name string, amount double, unit string, weighable boolean, price double"
SP = "sp_id long, product_id long, chain_id int, name string, amount double, unit string, weighable boolean, has_image boolean"

#: sp, product, chain, name, amount, unit, weighable, image
CATALOG = [
    (10, 100, 1, "Test SP", None, None, False, True),
    (11, 101, 1, "Milk", 1.0, "l", False, True),
    (12, 102, 1, "Peppers BON VIA", 180.0, "g", False, True),
    (13, 103, 1, "Peppers", 1.0, "kg", True, True),
    (14, 104, 1, "Carrots", 1.0, "kg", False, True),
    (15, 105, 1, "Red peppers", None, None, False, True),
    (16, 106, 1, "Peppers each", 1.0, "vnt", False, True),
    (20, 200, 1, "Butter", 0.5, "kg", False, True),
    (30, 200, 2, "Butter of two", 0.5, "kg", False, True),
    (31, 201, 2, "Cheese", 1.0, "kg", False, True),
    (32, 202, 2, "Unpriced", None, None, False, True),
    (33, 203, 2, "Bread", None, None, False, True),
    (40, 300, 1, "garbled", 2.0, "kg", False, False),
    (41, 301, 1, "Garbled", 2.0, "kg", False, True),
    (42, 302, 1, "GARBLED", None, None, None, True),
]
LATEST = [(30, 2.0), (31, 2.0), (33, 10.0)]


def line(sp_id=None, name="Test Product", amount=None, unit=None, weighable=False, price=2.0, confidence=None, chain=1):
    return (chain, sp_id, confidence, name, amount, unit, weighable, price)


CASES = [
    # a choice of the same chain
    (line(10), (10, "reused", False, None, False)),
    (line(11, amount=1.2, unit="l"), (11, "reused", False, None, False)),
    (line(11, amount=1.51, unit="l"), (None, "unmatched", False, None, False)),  # over 30 % off
    (line(12, name="Peppers", weighable=True, price=3.49), (13, "reused", False, None, False)),  # by weight, a pack: by name instead
    (line(13, weighable=True, unit="kg", price=3.99, confidence=0.9), (13, "reused", False, None, False)),
    (line(13), (None, "unmatched", False, None, False)),  # a pack, by weight
    (line(14, weighable=True, price=1.85, confidence=0.9), (14, "reused", False, None, True)),
    (line(14, weighable=True, price=1.85, confidence=0.6), (None, "unmatched", False, None, False)),
    (line(15, weighable=True, unit="kg", price=3.49, confidence=0.95), (15, "reused", False, None, True)),
    (line(16, weighable=True, confidence=0.95), (None, "unmatched", False, None, False)),
    (line(12, weighable=True, confidence=0.95), (None, "unmatched", False, None, False)),
    # a choice of another chain
    (line(30, amount=0.5, unit="kg"), (20, "reused", True, None, False)),
    (line(30), (20, "reused", True, None, False)),
    (line(30, price=2.4), (20, "reused", True, None, False)),
    (line(30, price=2.41), (None, "unmatched", False, "price_out_of_band", False)),
    (line(30, price=1.2), (20, "reused", True, None, False)),
    (line(30, price=1.19), (None, "unmatched", False, "price_out_of_band", False)),
    (line(31, amount=1.0, unit="kg"), (None, "unmatched", True, None, False)),  # no product of that kind here
    (line(31, amount=0.5, unit="kg"), (None, "unmatched", False, "amount_mismatch", False)),
    (line(31, amount=1.0, unit="l"), (None, "unmatched", False, "amount_mismatch", False)),
    (line(32, price=99.0), (None, "unmatched", True, None, False)),  # nothing to compare with
    (line(33, name="Garbled", price=1.0), (None, "unmatched", False, "price_out_of_band", False)),  # a refused choice isn't looked up by name
    # by name
    (line(name="GARBLED", amount=2.0, unit="kg"), (41, "reused", False, None, False)),  # image first
    (line(name="garbled", amount=3.0, unit="kg"), (42, "reused", False, None, False)),  # unknown size fits all
    (line(name="garbled", amount=2.0, unit="kg", chain=2), (None, "unmatched", False, None, False)),
    (line(999, name="Butter"), (20, "reused", False, None, False)),  # the choice is gone
    (line(), (None, "unmatched", False, None, False)),
    (line(999, name=" "), (None, "unnamed", False, None, False)),
    (line(name=None), (None, "unnamed", False, None, False)),
    # without a price nothing may be made, but all may be reused
    (line(price=0.0), (None, "skipped_unpriced", False, None, False)),
    (line(price=None), (None, "skipped_unpriced", False, None, False)),
    (line(10, price=0.0), (10, "reused", False, None, False)),
    (line(name="Butter", price=0.0), (20, "reused", False, None, False)),
    (line(30, price=0.0), (20, "reused", True, None, False)),
    (line(31, amount=0.5, unit="kg", price=0.0), (None, "skipped_unpriced", False, None, False)),
    (line(31, price=0.0), (None, "skipped_unpriced", False, None, False)),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, SP)


def test_lines(spark, catalog):
    rows = [(i, *x) for i, (x, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:2], LINE)
    found = lines.resolved_lines(df, catalog, spark.createDataFrame(LATEST, "sp_id long, latest_price double")).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        assert (r.sp_id, r.source, r.crossed, r.reject, r.heals) == CASES[r.line_id][1], CASES[r.line_id]
    assert lines.resolved_lines(df.limit(0), catalog, spark.createDataFrame(LATEST, "sp_id long, latest_price double")).count() == 0


OFFER = "offer_id long, chain_id int, name string, amount double, unit string, codes array<string>, price double, promo_price double, promo_start date, promo_end date, coupon boolean, has_image boolean, name_authority boolean"


def test_offers(spark, catalog):
    import datetime

    day = lambda n: datetime.date(2001, 1, n)
    offer = lambda i, name, chain=1, amount=None, unit=None, codes=None, price=2.0, promo=1.5, start=day(1), end=day(9), coupon=False, image=False, authority=False: (i, chain, name, amount, unit, codes, price, promo, start, end, coupon, image, authority)
    offers = spark.createDataFrame([
        offer(1, "milk", amount=1.0, unit="l", codes=["000555", "12", "abc", "555"], image=True, authority=True),
        offer(2, "Mylk", amount=1.0, unit="l", codes=["0777", "888"], authority=True),
        offer(3, "Joined", codes=["999"]),
        offer(4, "Borrowed"), offer(5, "Agreed"), offer(6, "New"), offer(7, "New"),
        offer(8, "Butter", amount=0.5, unit="kg", promo=None, start=None, end=day(20)),
        offer(9, "Cheese", chain=2, codes=["555"]), offer(10, "Test SP", codes=["444"], price=2.0005, authority=True), offer(11, "garbled", amount=2.0, unit="kg", codes=["666"], image=True),
        offer(12, "GARBLED", codes=["321"], image=True), offer(13, "Nowhere", chain=9),
    ], OFFER)
    matches = spark.createDataFrame([(2, "chain_sp", 11, None), (3, "join", 31, None), (4, "mint_borrowed", None, "dairy"), (5, "mint_consensus", None, "bread"), (6, "uncategorised", None, None), (8, "join", 31, None)], "offer_id long, via string, sp_id long, category string")
    codes = spark.createDataFrame([(1, "555", 11), (1, "777", 14), (1, "888", 12), (1, "999", 31), (2, "555", 11), (1, "666", 40), (1, "444", 15)], "chain_id int, code string, sp_id long")
    latest = spark.createDataFrame([
        (11, 1, 2.0, 1.5, day(1), day(9), False), (11, 2, 2.0, 1.5, day(1), day(5), None), (11, 3, 2.0, None, day(1), day(9), False),
        (20, 1, 2.0, None, None, day(9), False), (20, 2, 2.0, None, None, None, False), (20, 3, 2.0, None, None, day(25), False),
        (10, 1, 2.0, 1.5, day(1), day(9), False), (10, 2, 2.0, 1.5, day(2), day(9), False), (10, 3, 2.0, 1.5, day(1), day(9), True),
    ], "sp_id long, store_id int, price double, promo_price double, promo_start date, promo_end date, coupon boolean")
    stores = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "store_id int, chain_id int")
    rows = {r.offer_id: r for r in upserts.upserted(offers, catalog, matches, codes, latest, stores).collect()}
    of = lambda i: (rows[i].result, rows[i].via, rows[i].sp_id, rows[i].product_id, rows[i].category, rows[i].review)
    assert of(1) == ("inserted", "exact", 11, 101, None, False)
    assert of(2) == ("inserted", "chain_sp", 11, 101, None, False)
    assert of(3) == ("sp_created", "join", None, 201, None, False)
    assert of(4) == ("product_created", "mint_borrowed", None, None, "dairy", True)
    assert of(5) == ("product_created", "mint_consensus", None, None, "bread", False)
    assert of(6) == of(7) == ("product_created", "uncategorised", None, None, None, False)
    assert of(8) == ("skipped", "exact", 20, 200, None, False)
    assert of(9)[:3] == ("inserted", "exact", 31) and of(11)[:3] == ("inserted", "exact", 41) and of(12)[2] == 41
    assert of(13)[0] == "product_created" and rows[13].stores_insert == 0
    counted = lambda i: tuple(rows[i][f"codes_{a}"] for a in ("insert", "confirm", "merge", "move"))
    assert [counted(i) for i in (1, 2, 3, 4, 9, 10, 11, 12)] == [(0, 1, 0, 0), (0, 0, 1, 1), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 1, 0), (0, 0, 1, 0), (1, 0, 0, 0)]
    stored = lambda i: (rows[i].stores_insert, rows[i].stores_extend, rows[i].stores_keep)
    assert [stored(i) for i in (1, 3, 8, 9, 10)] == [(1, 1, 1), (3, 0, 0), (0, 1, 2), (1, 0, 0), (2, 0, 1)]
    assert {i for i, r in rows.items() if r.renamed} == {1, 2} and {i for i, r in rows.items() if r.fills_image} == set()
    keys = {r.offer_id: r.key for r in upserts.placed(offers, catalog, matches).collect()}
    assert keys[6] == keys[7] != keys[13] and keys[1] == keys[2] == "11"
    assert upserts.upserted(offers.limit(0), catalog, matches, codes, latest, stores).count() == 0
