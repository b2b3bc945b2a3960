from pricewright.operators import files, greedy


def plain(cands, pairs, slots):
    out = []
    for user in {u for u, _, _ in cands}:
        left, chosen = {i: p for u, i, p in cands if u == user}, []
        while left and len(chosen) < slots:
            value = {i: round(p * (1 + sum(s for a, b, s in pairs for c in chosen if {a, b} == {i, c})), 9) for i, p in left.items()}
            best = min(value, key=lambda i: (-value[i], i))
            chosen.append(best)
            del left[best]
            out.append((user, len(chosen), best))
    return sorted(out)


def test_greedy_fill(spark):
    cands = [(u, i, ((u * 7 + i * 3) % 10) / 10) for u in range(4) for i in range(9)]
    pairs = [(i, j, ((i * j) % 5) / 4) for i in range(9) for j in range(i + 1, 9)]
    c = spark.createDataFrame(cands, "user_id long, product_id long, p double")
    p = spark.createDataFrame(pairs, "a long, b long, score double")
    assert sorted(map(tuple, greedy.greedy_fill(c, p, 5).collect())) == plain(cands, pairs, 5)
    assert len(greedy.greedy_fill(c, p.limit(0), 20).collect()) == 36
    assert greedy.greedy_fill(c.limit(0), p, 5).count() == 0


def test_products_without_a_pair(spark):
    """Only as many of them as there are slots are asked; equal ones by the least id, near ones all of them."""
    cands = [(1, i, [0.5, 0.25][i % 2]) for i in range(60)] + [(2, i, 0.5 - i * 1e-10) for i in range(40)] + [(3, i, 0.1 * (i % 7)) for i in range(50)] + [(4, 1, 0.2)]
    pairs = [(3, 41, 1.5), (41, 47, 0.75), (1, 59, 0.5)]
    c, p = spark.createDataFrame(cands, "user_id long, product_id long, p double"), spark.createDataFrame(pairs, "a long, b long, score double")
    assert sorted(map(tuple, greedy.greedy_fill(c, p, 5).collect())) == plain(cands, pairs, 5)
    kept = {u: len(greedy.worth_asking({i: v for x, i, v in cands if x == u}, {3, 41}, 5)) for u in range(1, 5)}
    assert kept == {1: 7, 2: 40, 3: 7, 4: 1}


def test_round_trips(spark):
    df = spark.createDataFrame([(1, "a,b \"c\""), (2, None), (3, "line")], "id long, text string")
    for kind in ("csv", "json"):
        assert sorted(map(tuple, files.exported(df, kind).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
