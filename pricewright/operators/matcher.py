"""Matching of written product names with catalogue names: lanes of evidence, their confidence, the best matches.

Names are compared once per pair of different names; what hangs on the product (size, unit, category)
is joined to the scored pairs afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import names, stems, units


@dataclass(frozen=True)
class Bars:
    """Thresholds and weights of the matcher."""

    token: float = 0.75  # a token counts as found
    relaxed_token: float = 0.5  # the same among candidates that their price has picked
    glue: float = 0.85  # two halves of a split word count as found
    anchor_rescue: float = 0.8
    char_floor: float = 0.72
    char_discount: float = 0.95
    ocr_rescue: float = 0.65
    noun_floor: float = 0.6
    noun_penalty: float = 0.15
    noun_cap: float = 0.3
    subset_least: float = 0.75
    subset_weight: float = 0.9
    underdetermined: float = 0.6
    abbreviation: float = 0.03
    abbreviation_cap: float = 0.06
    extra_word: float = 0.03
    extra_word_cap: float = 0.09
    category_boost: float = 0.05
    amount_tolerance: float = 0.01
    amount_bonus: float = 0.05
    size_base: float = 0.05
    size_scale: float = 0.2
    size_cap: float = 0.2
    unit_penalty: float = 0.15
    number_penalty: float = 0.15
    least: float = 0.45


SHORT = 3  # tokens of so many letters tell little


def words(name: Column) -> Column:
    """The words of a normal name, each with its stem."""
    return F.transform(F.filter(F.split(name, " "), lambda t: t != ""), lambda t: F.struct(t.alias("w"), stems.match_stem(t).alias("s")))


def closeness(a: Column, b: Column, stemmed: bool = True) -> Column:
    """1 for equal words, 0 for unequal short ones, else the similarity of the words or, a little less worth, of their stems."""
    raw = names.similarity(a["w"], b["w"])
    if stemmed:
        changed = ((a["s"] != a["w"]) | (b["s"] != b["w"])) & (F.length(a["s"]) > SHORT) & (F.length(b["s"]) > SHORT)
        raw = F.greatest(raw, F.when(changed, names.similarity(a["s"], b["s"]) * 0.98).otherwise(0.0))
    return F.when(a["w"] == b["w"], 1.0).when((F.length(a["w"]) <= SHORT) | (F.length(b["w"]) <= SHORT), 0.0).otherwise(raw)


def best(word: Column, others: Column, stemmed: bool = True) -> Column:
    return F.coalesce(F.array_max(F.transform(others, lambda o: closeness(word, o, stemmed))), F.lit(0.0))


def long_words(ws: Column) -> Column:
    return F.filter(ws, lambda t: F.length(t["w"]) > SHORT)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def healed(query: Column, name: Column, bars: Bars) -> Column:
    """Words of the query, with two neighbours glued where the first is not found alone but both together are."""
    glued = lambda i: words(F.concat(F.get(query, i)["w"], F.get(query, i + 1)["w"]))[0]
    lost = lambda i: (best(F.get(query, i), name) < bars.token) & (i + 1 < F.size(query)) & (best(glued(i), name) >= bars.glue)
    at = F.when(F.size(query) > 0, F.sequence(F.lit(0), F.size(query) - 1)).otherwise(F.array().cast("array<int>"))
    # taken[i + 1] says whether word i takes the next one along; a word that was taken takes none.
    taken = F.aggregate(at, F.array(F.lit(False)), lambda acc, i: F.concat(acc, F.array(F.coalesce(lost(i) & ~F.element_at(acc, -1), F.lit(False)))))
    kept = F.filter(at, lambda i: ~F.get(taken, i))
    return F.transform(kept, lambda i: F.when(F.get(taken, i + 1), glued(i)).otherwise(F.get(query, i)))


def token_score(query: Column, name: Column, floor: float, stemmed: bool = True) -> Column:
    """Share of the query's letters in words that the name has; 0 where too few words of either side are found."""
    found = F.transform(query, lambda t: best(t, name, stemmed))
    hits = F.size(F.filter(found, lambda b: b >= floor))
    weighed = total(F.zip_with(query, found, lambda t, b: F.when(b >= floor, b * F.length(t["w"])).otherwise(0.0)))
    size = total(F.transform(query, lambda t: F.length(t["w"]).cast("double")))
    n_long = F.size(long_words(query))
    covered = hits / F.when(n_long > 0, n_long).otherwise(F.size(query)) >= F.when(n_long >= 3, 0.67).otherwise(0.5)
    theirs = long_words(name)
    theirs_found = F.size(F.filter(theirs, lambda t: best(t, query, stemmed) >= floor))
    enough = (F.size(theirs) < n_long + 1) | (theirs_found / F.size(theirs) >= 0.4)
    return F.when((F.size(query) == 0) | (F.size(name) == 0), 0.0).when(covered & enough, weighed / size).otherwise(0.0)


def noun_penalty(query: Column, name: Column, bars: Bars) -> Column:
    """For every long word of the query without a counterpart in the name."""
    theirs = long_words(name)
    missing = F.size(F.filter(long_words(query), lambda t: best(t, theirs) < bars.noun_floor))
    return F.when(F.size(theirs) == 0, 0.0).otherwise(F.least(F.lit(bars.noun_cap), missing * bars.noun_penalty))


def docked_token_score(df: DataFrame, floor: float, bars: Bars, out: str) -> DataFrame:
    """Adds the token score less the noun penalty; with a penalty, stems don't count."""
    df = df.withColumn("_plain", token_score(F.col("_q"), F.col("_n"), floor)).withColumn("_penalty", noun_penalty(F.col("_q"), F.col("_n"), bars))
    raw = F.when(F.col("_penalty") > 0, token_score(F.col("_q"), F.col("_n"), floor, stemmed=False)).otherwise(F.col("_plain"))
    return df.withColumn(out, F.when(F.col("_plain") > 0, F.greatest(F.lit(0.0), raw - F.col("_penalty"))).otherwise(0.0)).drop("_plain", "_penalty")


def char_similarity(a: Column, b: Column, weighted: Column | None = None, bars: Bars = Bars()) -> Column:
    """Similarity of the names without blanks; 0 if one has under two fifths of the other's length.

    ``weighted`` is their distance with cheap look-alikes; it counts for names that are close already.
    """
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    longest, least = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    plain = 1 - F.levenshtein(x, y) / longest
    rescued = plain if weighted is None else F.when(plain >= bars.ocr_rescue, 1 - weighted / longest).otherwise(plain)
    return F.when((longest == 0) | (least / longest < 0.4), 0.0).otherwise(rescued)


def name_confidence(pairs: DataFrame, typed: bool, bars: Bars = Bars(), weighted: str | None = None) -> DataFrame:
    """Adds to pairs of normal names (``query``, ``name``): gated, is_healed, token, char, subset, abbrev, confidence.

    ``typed`` is for clean names: no split words are mended, and words that only the name has cost a little.
    ``weighted`` names a column with the look-alike distance of the two names without blanks. An empty or null
    name has confidence 0 (nulls count as empty). Other columns stay; names with a leading underscore are taken.
    """
    q0, n0 = words(F.coalesce("query", F.lit(""))), words(F.coalesce("name", F.lit("")))
    df = pairs.withColumn("_q0", q0).withColumn("_n", n0)
    df = df.withColumn("_q", F.col("_q0") if typed else healed(F.col("_q0"), F.col("_n"), bars))
    df = df.withColumn("_char", char_similarity(F.coalesce("query", F.lit("")), F.coalesce("name", F.lit("")), F.col(weighted) if weighted else None, bars))
    ours, theirs = names.significant_tokens(F.coalesce("query", F.lit(""))), names.significant_tokens(F.coalesce("name", F.lit("")))
    df = df.withColumn("_shared", F.arrays_overlap(ours, theirs)).withColumn("_fewest", F.least(F.size(ours), F.size(theirs)))
    df = docked_token_score(df, bars.token, bars, "token")
    q, n = F.col("_q"), F.col("_n")
    long_q, long_n = long_words(q), long_words(n)
    starts = lambda t: F.exists(long_n, lambda c: c["w"].startswith(t["w"]))
    covered = F.size(F.filter(long_q, lambda t: (best(t, n) >= bars.token) | starts(t))) / F.size(long_q)
    df = df.withColumn("_covered", F.when(F.size(long_q) == 0, 0.0).otherwise(covered))
    df = df.withColumn("_under", (F.size(long_q) <= 1) & (F.size(long_n) - F.size(long_q) >= 2))
    known = F.transform(n, lambda c: c["w"])
    hits = F.size(F.filter(q, lambda t: (F.length(t["w"]) <= SHORT) & t["w"].rlike("[a-z]") & ~F.array_contains(known, t["w"]) & starts(t)))
    extra = F.size(F.filter(long_n, lambda c: best(c, q) < bars.token))
    subset = F.when(F.col("_shared") & (F.col("_covered") >= bars.subset_least), F.col("_covered") * bars.subset_weight).otherwise(0.0)
    df = df.withColumn("subset", F.when(F.col("_under"), F.least(subset, F.lit(bars.underdetermined))).otherwise(subset))
    df = df.withColumn("abbrev", F.when(F.col("_shared"), F.least(F.lit(bars.abbreviation_cap), hits * bars.abbreviation)).otherwise(0.0))
    df = df.withColumn("char", F.when(F.col("_char") >= bars.char_floor, F.col("_char") * bars.char_discount).otherwise(0.0))
    df = df.withColumn("gated", (F.col("_fewest") == 1) & ~F.col("_shared") & (F.col("_char") < bars.anchor_rescue))
    lanes = F.greatest("token", "char")
    nudged = F.least(F.lit(1.0), F.greatest(lanes, "subset") + F.col("abbrev"))
    nudged = F.when(F.col("_under") & (F.col("subset") > 0), F.least(nudged, F.greatest(lanes, F.lit(bars.underdetermined)))).otherwise(nudged)
    if typed:
        nudged = F.greatest(F.lit(0.0), nudged - F.least(F.lit(bars.extra_word_cap), extra * bars.extra_word))
    empty = (F.size("_q0") == 0) | (F.size("_n") == 0)
    df = df.withColumn("is_healed", F.size("_q") != F.size("_q0")).withColumn("confidence", F.when(F.col("gated") | empty, 0.0).otherwise(nudged))
    return df.drop("_q0", "_q", "_n", "_char", "_shared", "_fewest", "_covered", "_under")


def relaxed_confidence(pairs: DataFrame, bars: Bars = Bars()) -> DataFrame:
    """Adds the ``relaxed`` score to pairs (``query``, ``name``) that an equal price has picked already: the token lane with a low bar."""
    df = pairs.withColumn("_q0", words(F.coalesce("query", F.lit("")))).withColumn("_n", words(F.coalesce("name", F.lit(""))))
    df = df.withColumn("_q", healed(F.col("_q0"), F.col("_n"), bars))
    return docked_token_score(df, bars.relaxed_token, bars, "relaxed").drop("_q0", "_q", "_n")


def name_pairs(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs (query, name) of different texts that share a word of four letters or more; both sides have a normal ``name``."""
    token = lambda df, to: df.select(F.col("name").alias(to)).distinct().select(to, F.explode(names.significant_tokens(F.col(to))).alias("word"))
    return token(asked, "query").join(token(catalog, "name"), "word").select("query", "name").distinct()


def fixed_form(amount: Column, unit: Column) -> Column:
    """Whether a packaged product has a size that loose goods don't have (anything but one kilogram)."""
    return amount.isNotNull() & unit.isNotNull() & ~((unit == "kg") & (amount == 1))


def numbers(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def with_product_evidence(scored: DataFrame, bars: Bars = Bars()) -> DataFrame:
    """Scored pairs of products with the confidence after category, size, unit and numbers; pairs of unlike form go.

    Columns: confidence, query, name, scope (a category or null), category, and amount, unit, weighable of both
    sides, the asked one's with ``asked_`` before. Null sizes give no evidence.
    """
    c = F.col
    apart = c("weighable") != c("asked_weighable")
    packaged = F.when(c("weighable"), fixed_form(c("asked_amount"), c("asked_unit"))).otherwise(fixed_form(c("amount"), c("unit")))
    near = F.abs(c("asked_amount") - c("amount")) < bars.amount_tolerance
    off = F.abs(c("asked_amount") - c("amount")) / F.greatest("asked_amount", "amount", F.lit(1.0))
    boosted = F.when(c("scope") == c("category"), F.least(F.lit(1.0), c("confidence") + bars.category_boost)).otherwise(c("confidence"))
    same = units.same_unit(c("asked_unit"), c("unit"))
    sized = (
        F.when(same & near, F.least(F.lit(1.0), boosted + bars.amount_bonus))
        .when(same, F.greatest(F.lit(0.0), boosted - F.least(F.lit(bars.size_cap), bars.size_base + bars.size_scale * off)))
        .otherwise(F.greatest(F.lit(0.0), boosted - bars.unit_penalty))
    )
    known = c("asked_amount").isNotNull() & c("amount").isNotNull() & c("asked_unit").isNotNull() & c("unit").isNotNull()
    ours, theirs = numbers(c("query")), numbers(c("name"))
    odd = (F.size(ours) > 0) & (F.size(theirs) > 0) & (F.size(F.array_except(ours, theirs)) > 0)
    df = scored.where("confidence > 0").where((c("scope").isNull() | (c("scope") == c("category"))) & ~F.coalesce(apart & packaged, F.lit(False)))
    df = df.withColumn("confidence", F.when(known, sized).otherwise(boosted))
    return df.withColumn("confidence", F.round(F.when(odd, F.greatest(F.lit(0.0), c("confidence") - bars.number_penalty)).otherwise(c("confidence")), 6))


def best_matches(scored: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """The ``k`` most confident candidates of each asked product, ``least`` or more; ties to the smaller sp_id."""
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "sp_id")
    return scored.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
