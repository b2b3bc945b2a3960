"""The matcher, the look-alike distance and the pairing against plain versions."""

import random
import re
from functools import cache

import pytest
from pyspark.sql import functions as F

from pricewright.functions import names, stems
from pricewright.operators import lookalikes, matcher
from pricewright.operators.pairing import paired
from pricewright.plans import registry

BARS = matcher.Bars()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def lookalike(a, b):
    swaps = [(x, y, c) for p, q, c in lookalikes.ONE_FOR_ONE + lookalikes.SEVERAL for x, y in ((p, q), (q, p))]

    @cache
    def cost(i, j):
        if not i or not j:
            return i + j
        known = [cost(i - len(x), j - len(y)) + c for x, y, c in swaps if a[:i].endswith(x) and b[:j].endswith(y)]
        return min([cost(i - 1, j) + 1, cost(i, j - 1) + 1, cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]), *known])

    return cost(len(a), len(b))


def like(a, b):
    return 1 - distance(a, b) / max(len(a), len(b))


def plain_stem(w):
    if len(w) < 6:
        return w
    for e in sorted(stems.MATCH_ENDINGS, key=len, reverse=True):
        if w.endswith(e) and len(w) - len(e) >= 4:
            return w[: -len(e)]
    return w


def close(a, b, stemmed=True):
    if a == b:
        return 1.0
    if min(len(a), len(b)) <= 3:
        return 0.0
    out, sa, sb = like(a, b), plain_stem(a), plain_stem(b)
    if stemmed and (sa != a or sb != b) and min(len(sa), len(sb)) > 3:
        out = max(out, 0.98 * like(sa, sb))
    return out


def top(a, others, stemmed=True):
    return max((close(a, o, stemmed) for o in others), default=0.0)


def long_of(ws):
    return [w for w in ws if len(w) > 3]


def lane(q, n, bar, stemmed=True):
    if not q or not n:
        return 0.0
    found = [top(w, n, stemmed) for w in q]
    kl = len(long_of(q))
    if sum(f >= bar for f in found) / (kl or len(q)) < (0.67 if kl >= 3 else 0.5):
        return 0.0
    theirs = long_of(n)
    if len(theirs) >= kl + 1 and sum(top(w, q, stemmed) >= bar for w in theirs) / len(theirs) < 0.4:
        return 0.0
    return sum(f * len(w) for f, w in zip(found, q) if f >= bar) / sum(map(len, q))


def docked(q, n, bar):
    score, theirs = lane(q, n, bar), long_of(n)
    missing = sum(top(w, theirs) < BARS.noun_floor for w in long_of(q)) if theirs else 0
    penalty = min(BARS.noun_cap, missing * BARS.noun_penalty)
    return max(0.0, (lane(q, n, bar, False) if penalty else score) - penalty) if score > 0 else 0.0


def mended(q, n):
    out, i = [], 0
    while i < len(q):
        if top(q[i], n) < BARS.token and i + 1 < len(q) and top(q[i] + q[i + 1], n) >= BARS.glue:
            out.append(q[i] + q[i + 1])
            i += 1
        else:
            out.append(q[i])
        i += 1
    return out


def confidence(query, name, typed, weighted):
    q0, n = query.split(), name.split()
    if not q0 or not n:
        return 0.0
    x, y = query.replace(" ", ""), name.replace(" ", "")
    char = 0.0
    if min(len(x), len(y)) / max(len(x), len(y)) >= 0.4:
        char = like(x, y)
        if weighted and char >= BARS.ocr_rescue:
            char = 1 - lookalike(x, y) / max(len(x), len(y))
    sig = [{w for w in ws if len(w) >= 4 and re.search("[a-z]", w)} for ws in (q0, n)]
    if min(map(len, sig)) == 1 and not sig[0] & sig[1] and char < BARS.anchor_rescue:
        return 0.0
    q = q0 if typed else mended(q0, n)
    lanes = max(docked(q, n, BARS.token), char * BARS.char_discount if char >= BARS.char_floor else 0.0)
    out = lanes
    if sig[0] & sig[1]:
        lq, ln = long_of(q), long_of(n)
        starts = lambda w: any(o.startswith(w) for o in ln)
        cov = sum(top(w, n) >= BARS.token or starts(w) for w in lq) / len(lq) if lq else 0.0
        under = len(lq) <= 1 and len(ln) - len(lq) >= 2
        subset = cov * BARS.subset_weight if cov >= BARS.subset_least else 0.0
        subset = min(subset, BARS.underdetermined) if under else subset
        hits = sum(len(w) <= 3 and bool(re.search("[a-z]", w)) and w not in n and starts(w) for w in q)
        out = min(1.0, max(out, subset) + min(BARS.abbreviation_cap, hits * BARS.abbreviation))
        if under and subset > 0:
            out = min(out, max(lanes, BARS.underdetermined))
    if typed:
        out = max(0.0, out - min(BARS.extra_word_cap, BARS.extra_word * sum(top(w, q) < BARS.token for w in long_of(n))))
    return out


NAMES = [
    "atlantiniu lasisu gabalai", "atlantines lasisos gabaliukai", "kiaul iena be kaulo", "kiauliena be kaulo", "ryz1ai basmall", "ryziai basmati", "fasuoti obuoliai iki", "fasuotos bulves iki",
    "airanas", "safranas", "iki ledo f", "iki ledo formele zuvyte", "pienas 2 5 r", "pienas rokiskio 2 5 rieb", "sviestas", "naminis sviestas rokiskio", "", "3 a", "bananai", "bananai chiquita", "kar vytes saldainiai su ka", "karvytes saldainiai su kakava",
]


@pytest.mark.parametrize("typed", [True, False])
def test_name_confidence(spark, typed):
    pairs = [(a, b, float(lookalike(a.replace(" ", ""), b.replace(" ", "")))) for a in NAMES for b in NAMES] + [(None, "pienas", None), ("pienas", None, None)]
    df = spark.createDataFrame(pairs, "query string, name string, weighted double")
    got = matcher.name_confidence(df, typed=typed, weighted=None if typed else "weighted").select("query", "name", "confidence", "is_healed").collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r.confidence == pytest.approx(confidence(r.query or "", r.name or "", typed, not typed), abs=1e-9), (r.query, r.name)
    assert any(r.is_healed for r in got) != typed
    best = {r.query: r.name for r in sorted(got, key=lambda r: r.confidence) if r.query != r.name}
    if not typed:
        assert best["kiaul iena be kaulo"] == "kiauliena be kaulo" and best["ryz1ai basmall"] == "ryziai basmati"


def test_relaxed_confidence(spark):
    df = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES], "query string, name string")
    for r in matcher.relaxed_confidence(df).collect():
        assert r.relaxed == pytest.approx(docked(mended(r.query.split(), r.name.split()), r.name.split(), BARS.relaxed_token), abs=1e-9)


def test_scanned_confidence_of_the_catalog(spark, sf_dir):
    rows = registry.queries()["er02_scanned_confidence"](spark, sf_dir).collect()
    assert len(rows) > 400
    for r in rows:
        assert r.confidence == pytest.approx(confidence(r.query, r["name"], False, True), abs=2e-6)
    for r in registry.queries()["str11_lookalike_distance"](spark, sf_dir).collect():
        assert r.distance == pytest.approx(lookalike(r.query.replace(" ", ""), r["name"].replace(" ", "")), abs=2e-6)


def test_lookalike_distance(spark):
    pick = random.Random(5)
    texts = ["", "ryz14", "ryziai", "basmall", "basmati", "rnm", "m", "nn", "0o0c", "x" * 60] + ["".join(pick.choices("rnmcldvwutioe014", k=pick.randint(0, 9))) for _ in range(40)]
    rows = [(a, b) for a in texts for b in texts] + [(None, "a"), ("a", None), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lookalikes.lookalike_distance("a", "b").alias("d")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.d is None) if r.a is None or r.b is None else r.d == pytest.approx(lookalike(r.a, r.b))


def test_stems(spark):
    words = ["saldziausias", "sojos", "pienas", "as", "is", "gabalai", "lasisu", "rudojo", "petrazoles", "brandy", "eggs", "glass", "gas", ""]
    r = spark.createDataFrame([(words,)], "w array<string>").select(
        F.transform("w", stems.query_stem).alias("q"), F.transform("w", stems.match_stem).alias("m"), F.transform("w", stems.recipe_stem).alias("r"), F.transform("w", stems.english_singular).alias("e")
    ).first()
    assert r.q[:6] == ["saldz", "soj", "pien", "as", "is", "gabal"] and r.m == [plain_stem(w) for w in words]
    assert r.r[7] == "rud" and r.r[8] == "petrazol" and r.e[10:13] == ["egg", "glass", "gas"]
    one = spark.createDataFrame([("RIMI Kiaušiniai, 10 vnt.",)], "t string").select(names.cross_chain_name(F.col("t"))).first()[0]
    assert one == "kiausiniai 10 vnt"


def greedy(planned, bought, unassigned):
    free = [set(planned), set(bought)]
    out = set()
    for tier in ("product", "name", "category"):
        pairs = []
        for i, (p, w, c) in planned.items():
            for j, (p2, w2, c2) in bought.items():
                s = {"product": p is not None and p == p2, "name": len(set(w or ()) & set(w2 or ())), "category": c is not None and c == c2 and c != unassigned}[tier]
                if s and i in free[0] and j in free[1]:
                    pairs.append((-int(s), i, j))
        for _, i, j in sorted(pairs):
            if i in free[0] and j in free[1]:
                free[0].discard(i), free[1].discard(j)
                out.add((i, j, tier))
    return out


def test_pairing(spark):
    pick, rows = random.Random(3), ([], [])
    for side in rows:
        for key in [*range(30), None]:
            for i in range(pick.randint(0, 6)):
                words = None if pick.random() < 0.1 else pick.sample(["milk", "bread", "salt", "rice", "kale"], pick.randint(0, 3))
                side.append((key, i, pick.choice([None, 1, 2, 3, 4, 5]), words, pick.choice([None, "A", "B", "PROMO"])))
    schema = "trip long, id long, product_id long, words array<string>, category string"
    planned, bought = (spark.createDataFrame(r + r[:3], schema).withColumn("tier", F.lit("clash")) for r in rows)
    got = paired(planned, bought, "trip", "PROMO").collect()
    want = {(k, *m) for k in range(30) for m in greedy(*({i: x for t, i, *x in r if t == k} for r in rows), "PROMO")}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30
    assert paired(planned.limit(0), bought, "trip", "PROMO").count() == 0


def test_pairing_needs_no_python_workers(spark, sf_dir):
    """Lines are paired where they are: no row goes to Python, and a receipt's lines are gathered once for both sides."""
    plan = registry.queries()["join13_list_and_receipt"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "Python" not in plan


def test_repeated_ids_are_taken_once(spark):
    """One id with two products is one line, that of the smaller product, whatever the order of rows."""
    schema = "trip long, id long, product_id long, words array<string>, category string"
    planned = spark.createDataFrame([(1, 7, 5, ["milk"], "A"), (1, 7, 4, ["rice"], "B"), (1, 8, 6, [], "C")], schema)
    bought = spark.createDataFrame([(1, 1, 5, ["milk"], "A"), (1, 2, 9, ["rice", "kale"], "Z"), (1, 3, 6, None, "C")], schema)
    assert sorted(map(tuple, paired(planned, bought, "trip", "PROMO").collect())) == [(1, 7, 2, "name"), (1, 8, 3, "product")]


def test_list_and_receipt(spark, sf_dir):
    rows = registry.queries()["join13_list_and_receipt"](spark, sf_dir).collect()
    assert {r.tier for r in rows} == {"product", "name", "category"}
    assert len({(r.receipt_id, r.planned_id) for r in rows}) == len(rows) == len({(r.receipt_id, r.bought_id) for r in rows})


def test_price_fishing(spark, sf_dir):
    q = registry.queries()["er12_price_fishing"](spark, sf_dir).collect()
    from pricewright.sources.domain import Domain

    d = Domain(spark, sf_dir)
    title = {r.sp_id: r["name"] for r in d.sp.select("sp_id", names.normal_name(F.col("name")).alias("name")).collect()}
    prices = d.price.select("id", "sp_id", "store_id", "price", "is_fallback").collect()
    offers = {}
    for p in prices:
        if not p.is_fallback:
            offers.setdefault(p.store_id, []).append((p.price, p.sp_id))
    want = {}
    for p in prices:
        if p.is_fallback:
            a = title[p.sp_id].split()
            for price, sp in offers.get(p.store_id, ()):
                b = title[sp].split()
                if sp != p.sp_id and abs(price - p.price) <= 1 and {w for w in a if len(w) >= 4} & {w for w in b if len(w) >= 4}:
                    score = docked(mended(a, b), b, BARS.relaxed_token)
                    if score > 0:
                        want.setdefault((p.id, p.sp_id), {})[sp] = round(score, 6)
    want = {(*k, sp, s) for k, v in want.items() for sp, s in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:3]}
    assert {(r.id, r.asked_id, r.sp_id, r.score) for r in q} == want and want


def test_paths(spark):
    nodes = spark.createDataFrame([("a", None, "food"), ("b", "a", "dairy"), ("c", "b", "milk"), ("d", None, "home"), ("e", "d", "dairy")], "id string, parent string, name string")
    paths = [(1, ["food", "dairy", "milk"]), (2, ["food", "x", "milk"]), (3, ["dairy"]), (4, ["x", "milk"]), (5, ["x"]), (6, []), (7, None), (8, ["home", "dairy", "milk"])]
    got = {r.k: r.found for r in names.walked(spark.createDataFrame(paths, "k int, path array<string>"), nodes, "k").collect()}
    assert got == {1: "c", 2: "a", 3: "b", 4: "c", 5: None, 6: None, 7: None, 8: "e"}
