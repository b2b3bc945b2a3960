"""Units in recipes and lookup of ingredients by their longest run of words."""

import pytest
from pyspark.sql import functions as F

from pricewright.functions import names, recipe_units, stems
from pricewright.operators import lexicon

CASES = {
    "tsp.": "tsp", "vnt.": "pcs", "  TBSP  ": "tbsp", "Šaukštas": "tbsp", "fl. oz.": "floz", "v. š.": "tbsp", "valg.š.": "tbsp", "arb. š.": "tsp", "sauksteliu": "tsp", "ziupsneliai": "pinch",
    "saukstas": "tbsp", "valgomuju saukstu": "tbsp", "valgomieji šaukštai": "tbsp", "arbatinius šaukštelius": "tsp", "arbatinio šaukšto": "tsp", "stikline": "glass", "stiklinių": "glass", "sakeliu": "sprig",
    "galvučių": "head", "pakuočių": "pack", "galvos": "head", "saują": "handful", "ryšulėlio": "bunch", "riekelių": "slice", "lapelių": "sheet", "ribs": "stalk", "jars": "can", "each": "pcs", "gramų": "g", "ml": "ml",
    "pounds": "lb", "glasses": "glass", "puodelio": "glass", "skiltelėmis": "clove", "šlakelio": "drop", "cm": "cm", "centimetrų": "cm", "lašai": "drop", "stiebų": "stalk",
    "druskos": None, "vištienos": None, "chicken": None, "": None, "   ": None, "t": None, "T": None, "mm": None, "stick": None, "desertinis šaukštas": None,
}


def test_units(spark):
    df = spark.createDataFrame([(p,) for p in CASES] + [(None,)], "phrase string")
    got = {r.phrase: r for r in recipe_units.with_unit(df, "phrase").collect()}
    assert {p: got[p].unit for p in CASES} == CASES and got[None].unit is None
    assert (got["v. š."].dimension, got["v. š."].metric, got["v. š."].vague) == ("volume", 15.0, False)
    assert (got["stikline"].metric, got["stikline"].vague) == (250.0, True) and (got["each"].dimension, got["each"].metric) == ("count", None)
    known = set(recipe_units.names().values())
    assert known >= set(recipe_units.GRAMS) | set(recipe_units.MILLILITRES) | set(recipe_units.VAGUE) and max(len(n.split()) for n in recipe_units.names()) == recipe_units.MAX_WORDS


LEXICON = [
    ("flour_wheat", "kvietiniai miltai", "lt"), ("flour_wheat", "flour", "en"), ("sour_cream", "grietinė", "lt"), ("sour_cream", "sour cream", "en"), ("garlic", "česnakas", "lt"), ("oil_olive", "alyvuogių aliejus", "lt"), ("oil_olive", "alyvuogių aliejaus", "lt"),
    ("oil", "aliejus", "lt"), ("oil", "aliejaus", "lt"), ("carrot", "carrot", "en"), ("brandy", "brandy", "en"), ("pasta", "pasta", "en"), ("pepper_black", "pipirai", "lt"), ("butter", "sviestas", "lt"), ("soda_water", "seltzer", "en"),
    ("milk_chocolate", "pieno šokoladas", "lt"), ("milk", "pienas", "lt"), ("bacon", "rūkyta šoninė", "lt"), ("belly", "kiaulienos šoninė", "lt"), ("later", "carrot", "en"),
]


@pytest.mark.parametrize(
    "phrase,key,form,exact",
    [
        ("kvietinių miltų", "flour_wheat", "kvietiniu miltu", False), ("grietinės", "sour_cream", "grietines", False), ("česnako", "garlic", "cesnako", False),
        ("alyvuogių aliejaus", "oil_olive", "alyvuogiu aliejaus", True), ("šalto aliejaus", "oil", "aliejaus", True), ("all-purpose flour", "flour_wheat", "flour", True), ("Sour cream", "sour_cream", "sour cream", True),
        ("", None, None, None), ("kepimo maišelį sudėti karką", None, None, None), (None, None, None, None), ("baby carrots, peeled", "carrot", "carrots", False), ("brand", None, None, None), ("paste", None, None, None), ("tamarind paste", None, None, None),
        ("brandy", "brandy", "brandy", True), ("pasta", "pasta", "pasta", True), ("pipirų", "pepper_black", "pipiru", False), ("pipirus", "pepper_black", "pipirus", False), ("sviestą", "butter", "sviesta", False),
        ("seltzers", "soda_water", "seltzers", False), ("pieno šokoladą", "milk_chocolate", "pieno sokolada", False), ("pienas ir česnako", "milk", "pienas", True), ("česnako ir pienas", "milk", "pienas", True),
        ("pieno ir česnako", "milk", "pieno", False),
    ],
)
def test_first_hit(lexicon_table, spark, phrase, key, form, exact):
    got = lexicon.first_hit(spark.createDataFrame([(1, phrase)], "id long, phrase string"), lexicon_table).collect()
    assert [(r.key, r.form, r.exact, r.words) for r in got] == ([(key, form, exact, len(form.split()))] if key else [])


@pytest.fixture(scope="module")
def lexicon_table(spark):
    return spark.createDataFrame([(k, f, lang, i) for i, (k, f, lang) in enumerate(LEXICON)], "key string, form string, lang string, place int").cache()


def test_all_hits_and_none(spark, lexicon_table):
    phrases = spark.createDataFrame([(1, "rūkyta šoninė, kiaulienos šoninė"), (2, "word " * 3000 + "pienas")], "id long, phrase string")
    assert sorted((r.id, r.key, r["at"]) for r in lexicon.lexicon_hits(phrases, lexicon_table).collect()) == [(1, "bacon", 0), (1, "belly", 2), (2, "milk", 3000)]
    assert lexicon.lexicon_hits(phrases, lexicon_table.limit(0)).count() == 0 == lexicon.lexicon_hits(phrases.limit(0), lexicon_table).count()


def test_plain_stems(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(names.tokens(F.col("text"))).alias("w")).distinct()
    more = spark.createDataFrame([(w,) for w in ("a", "as", "ass", "miltas", "miltais", "kvietiniaisiais", "ias", "iai", "glass", "eggs", "s", "ssss", "+s", "iaisiais")], "w string")
    rows = words.unionByName(more).select("w", stems.recipe_stem(F.col("w")).alias("stem"), stems.english_singular(F.col("w")).alias("one")).collect()
    assert len(rows) > 1000 and [(r.stem, r.one) for r in rows] == [(stems.plain_recipe_stem(r.w), stems.plain_english_singular(r.w)) for r in rows]


def leftmost(spark, phrases, lexicon_table):
    """The first of all hits, by the operator that has them all."""
    hits = lexicon.lexicon_hits(phrases, lexicon_table).groupBy("id").agg(F.min(F.struct("at", "key", "form", "words", "exact")).alias("h"))
    return sorted((r.id, r.h.key, r.h.form, r.h.words, r.h.exact, r.h["at"]) for r in hits.collect())


@pytest.mark.parametrize("entries,words", [(1_000_000, 300_000), (3, 1)])
def test_phrases_are_settled_where_they_are(spark, lexicon_table, monkeypatch, entries, words):
    """Long phrases that are full of hits leave one row each, also with a lexicon in parts; ids may repeat, phrases be null or empty."""
    monkeypatch.setattr(lexicon, "IN_TASKS", entries)
    monkeypatch.setattr(lexicon, "HELD", entries)
    monkeypatch.setattr(lexicon, "WORDS_AT_ONCE", words)
    texts = ["pienas miltai carrots " * 50, "seltzers česnako pieno šokoladas " * 30, None, "", "nothing here", "carrots carrot", "alyvuogių aliejus " * 3, "sour cream sours creams"]
    phrases = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, "carrots carrot"), (0, texts[0])], "id long, phrase string")
    found = lexicon.first_hit(phrases, lexicon_table)
    got = sorted((r.id, r.key, r.form, r.words, r.exact, r["at"]) for r in found.collect())
    assert got == leftmost(spark, phrases, lexicon_table) and len(got) == 5
    assert most_shuffled(found) <= 7 * (1 if entries > 3 else -(-40 // 3))
    assert lexicon.first_hit(phrases, lexicon_table.limit(0)).count() == 0 == lexicon.first_hit(phrases.limit(0), lexicon_table).count()


def most_shuffled(df):
    """The most rows that any exchange of the finished plan wrote."""
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
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        todo += [children.apply(i) for i in range(children.size())]
    return most
