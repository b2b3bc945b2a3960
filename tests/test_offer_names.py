"""Confusions of letters and offers that name several products."""

import random
from collections import Counter

import pytest

from pricewright.functions.names import MARKED, PLAIN
from pricewright.operators import aggregated, confusions
from pricewright.plans import registry, upserts
from pricewright.sources.domain import Domain


def plain_ops(a, b):
    table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j - 1] + (a[i - 1] != b[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
    i, j, ops = len(a), len(b), []
    while i > 0 or j > 0:
        if i > 0 and j > 0 and table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            ops += [(a[i - 1], b[j - 1])] * (a[i - 1] != b[j - 1])
            i, j = i - 1, j - 1
        elif i > 0 and table[i][j] == table[i - 1][j] + 1:
            ops.append((a[i - 1], ""))
            i -= 1
        else:
            ops.append(("", b[j - 1]))
            j -= 1
    return ops


def plain_confusions(pairs, least_count=2):
    counts = Counter()
    for a, b in pairs:
        a, b = (" ".join((x or "").lower().translate(str.maketrans(MARKED, PLAIN)).split()) for x in (a, b))
        b = b[: len(a) + 3]
        ops = plain_ops(a, b)
        if a and b and 1 - len(ops) / max(len(a), len(b)) >= 0.65:
            counts.update(ops)
    return {k: n for k, n in counts.items() if n >= least_count or "" in k}


def test_alignment():
    r = random.Random(6)
    for _ in range(400):
        a, b = ("".join(r.choice("ab1l ") for _ in range(r.randrange(9))) for _ in range(2))
        assert confusions.aligned(a, b) == plain_ops(a, b)


def test_confusions(spark, sf_dir):
    pairs = [("P1enas", "Pienas"), ("p1enas", "Pienas"), ("SV1ESTAS", "Sviestas"), ("duona", "Duona ruginė su sėklomis"), ("batonas", "pomidorai"), ("kava", "kavva"), ("sūriss", "sūris"), (None, "x"), ("", "y"), ("agurka1", "agurkai")]
    got = {(r.read, r.truth): (r.n, r.kind) for r in confusions.confusions(spark.createDataFrame(pairs, "print string, name string")).collect()}
    assert {k: n for k, (n, _) in got.items()} == plain_confusions(pairs)
    assert got["1", "i"] == (4, "swap") and got["s", ""][1] == "invented" and got["", "v"][1] == "dropped" and not any("u" in k for k in got)
    rows = [tuple(r) for r in upserts.confirmed_prints(Domain(spark, sf_dir)).collect()]
    assert {(r.read, r.truth): r.n for r in registry.queries()["er25_confusions"](spark, sf_dir).collect()} == plain_confusions(rows)
    assert confusions.confusions(spark.createDataFrame([], "print string, name string")).count() == 0


CASES = {
    "Ledai PLOMBYRAS, 4 rūšių, 80 g": [("Ledai PLOMBYRAS", "80 g", 4)],
    "Jogurtas (įv. 6 rūšių), 2,5% rieb., 120 g, 400 g": [("Jogurtas", "120 g", 6), ("Jogurtas", "400 g", 6)],
    "Sausainiai rūšių a. r., 2 x 100 g": [("Sausainiai", "2 x 100 g", 3)],
    "Sultys, a. r., 3 rūšių": [("Sultys", None, 3)],
    "Rūkyta arba virta dešra, 300 g": [("Rūkyta dešra", "300 g", None), ("virta dešra", "300 g", None)],
    "Kiaulienos sprandinė arba kumpis, 1 kg, 500 g": [("Kiaulienos sprandinė", "1 kg", None), ("Kiaulienos kumpis", "500 g", None)],
    "Pomidorai raudonieji arba raudonoji paprika, 1 kg": [("Pomidorai raudonieji paprika", "1 kg", None), ("Pomidorai raudonoji paprika", "1 kg", None)],
    "Alus SVYTURYS arba KALNAPILIS, 0,5 l": [("Alus SVYTURYS", "0,5 l", None), ("Alus KALNAPILIS", "0,5 l", None)],
    "Vanduo AKVILE ir TICHE 7 UP, 1,5 l": [("Vanduo AKVILE", "1,5 l", None), ("Vanduo TICHE 7 UP", "1,5 l", None)],
    "Kava arba Kakavos gėrimas, 250 g": [("Kava gėrimas", "250 g", None), ("Kakavos gėrimas", "250 g", None)],
    "Pieno gėrimas arba Kakavos gėrimas": [("Pieno gėrimas", None, None), ("Kakavos gėrimas", None, None)],
    "Gaz. gėrimas 7 UP, MIRINDA, MOUNTAIN DEW, 1,5 l": [("Gaz. gėrimas 7 UP", "1,5 l", None), ("Gaz. gėrimas MIRINDA", "1,5 l", None), ("Gaz. gėrimas MOUNTAIN DEW", "1,5 l", None)],
    "Šokoladas MILKA, RITTER": [("Šokoladas MILKA, RITTER", None, None)],
    "Druska, 1 kg": [("Druska", "1 kg", None)],
    "Duona ir sviestas": [("Duona ir sviestas", None, None)],
    "Kiaušiniai, 10 vnt./pak.": [("Kiaušiniai", "10 vnt./pak.", None)],
    "": [], "  ": [],
}


@pytest.mark.parametrize("name", CASES)
def test_offer_cases(name):
    assert aggregated.expanded(name) == CASES[name]


def test_offers_as_rows(spark):
    offers = spark.createDataFrame([(i, n) for i, n in enumerate(CASES)] + [(99, None), (100, "Druska, 1 kg")], "offer_id int, name string")
    got = sorted((r.offer_id, r.part, r.product, r["size"], r.kinds) for r in aggregated.expand_offers(offers).collect())
    assert got == sorted((i, part, *x) for i, n in [*enumerate(CASES), (100, "Druska, 1 kg")] for part, x in enumerate(CASES[n]))
