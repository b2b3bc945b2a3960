"""Units as recipes write them: names in both languages, metric sizes, and which are only guesses.

Lithuanian nouns are declined by rule from their nominative, so the table holds words and not forms. Names are
looked up in lower case, without marks and full stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.names import MARKED, PLAIN

# Grams of mass units, millilitres of volume units, and units whose size is a guess.
GRAMS = {"g": 1.0, "kg": 1000.0, "oz": 28.3495, "lb": 453.592}
MILLILITRES = {
    "ml": 1.0, "l": 1000.0, "tsp": 5.0, "tbsp": 15.0, "cup": 240.0, "floz": 29.5735, "pint": 473.176, "quart": 946.353,
    "glass": 250.0, "pinch": 0.4, "drop": 0.05, "handful": 120.0,
}
VAGUE = "pinch handful bunch sprig can pack slice head stalk cm drop sheet glass".split()
# Abbreviations and English names; the latter are also taken with a plural s.
SHORT = {
    "g": "g gr", "kg": "kg kilo kilos", "oz": "oz", "lb": "lb lbs", "ml": "ml", "l": "l", "tsp": "tsp tsps a_š arb_š", "tbsp": "tbsp tbsps tbs v_š valg_š",
    "floz": "fl_oz", "pcs": "pc pcs vnt each", "pack": "pkg pkgs pak", "cm": "cm", "bunch": "bunches",
}
ENGLISH = {
    "g": "gram", "kg": "kilogram", "oz": "ounce", "lb": "pound", "ml": "millilitre milliliter", "l": "litre liter", "tsp": "teaspoon", "tbsp": "tablespoon",
    "cup": "cup", "floz": "fluid_ounce", "pint": "pint", "quart": "quart", "glass": "glass glasse", "pcs": "piece", "clove": "clove", "slice": "slice", "head": "head",
    "bunch": "bunch", "handful": "handful", "pinch": "pinch", "can": "can tin jar", "pack": "pack package packet punnet tub", "sprig": "sprig", "stalk": "stalk rib",
    "sheet": "sheet", "drop": "drop",
}
# Lithuanian names in the nominative.
LITHUANIAN = {
    "g": "gramas", "kg": "kilogramas", "ml": "mililitras", "l": "litras", "tsp": "šaukštelis", "tbsp": "šaukštas", "glass": "stiklinė puodelis", "pcs": "vienetas",
    "clove": "skiltelė", "slice": "riekė riekelė", "head": "galva galvutė", "bunch": "pundelis ryšulėlis", "handful": "sauja saujelė", "pinch": "žiupsnelis žiupsnis",
    "can": "skardinė", "pack": "pakelis pakuotė", "sprig": "šakelė", "stalk": "stiebas", "sheet": "lakštas lapas lapelis", "drop": "lašas lašelis šlakelis", "cm": "centimetras",
}
# Endings by the nominative's, from the language's grammar.
DECLENSIONS = {
    "as": "as o ą u e ai ų us ais", "is": "is io į iu yje iai ių ius iais", "ė": "ė ės ę e ėje ių es ėmis", "a": "a os ą oje ų as omis",
    "inis": "inis inio inį iniu iniai inių inius iniais", "asis": "asis ojo ąjį uoju ieji ųjų uosius aisiais",
}
#: Spoons with their adjective: both words stand in the same case.
QUALIFIED = [("tsp", "arbatinis", "inis", "šaukštelis", "is"), ("tsp", "arbatinis", "inis", "šaukštas", "as"), ("tbsp", "valgomasis", "asis", "šaukštas", "as")]
CASES = {"as": [0, 1, 2, 3, 5, 6, 7, 8], "is": [0, 1, 2, 3, 5, 6, 7, 8], "inis": range(8), "asis": range(8)}
#: The most words of a name.
MAX_WORDS = 2


def declined(noun: str) -> list[str]:
    """All forms of a regular noun; t and d soften before -ių."""
    end = next(e for e in ("as", "is", "ė", "a") if noun.endswith(e))
    stem = noun.removesuffix(end)
    soft = {"t": "č", "d": "dž"}.get(stem[-1], stem[-1])
    return [(stem[:-1] + soft if e.startswith("i") and end == "ė" else stem) + e for e in DECLENSIONS[end].split()]


def folded(text: str) -> str:
    return text.lower().translate(str.maketrans(MARKED, PLAIN))


def names() -> dict[str, str]:
    """Each folded name and its unit."""
    out: dict[str, str] = {}

    def add(unit: str, *forms: str) -> None:
        for form in forms:
            out.setdefault(folded(form.replace("_", " ")), unit)

    for unit, words in SHORT.items():
        add(unit, *words.split())
    for unit, words in ENGLISH.items():
        for word in words.split():
            add(unit, word, word + "s")
    for unit, words in LITHUANIAN.items():
        for word in words.split():
            add(unit, *declined(word))
    for unit, adjective, kind, noun, end in QUALIFIED:
        pairs = zip(CASES[kind], CASES[end], strict=True)
        add(unit, *(f"{adjective.removesuffix(kind)}{DECLENSIONS[kind].split()[i]} {noun.removesuffix(end)}{DECLENSIONS[end].split()[j]}" for i, j in pairs))
    for short, noun, end, unit in (("arb", "šaukštel", "is iai", "tsp"), ("valg", "šaukšt", "as ai", "tbsp")):
        add(unit, *(f"{short} {noun}{e}" for e in end.split()))
    return out


def unit_row(name: str, unit: str) -> tuple[str, str, str, float | None, bool]:
    dimension = "mass" if unit in GRAMS else "volume" if unit in MILLILITRES else "count"
    return name, unit, dimension, GRAMS.get(unit, MILLILITRES.get(unit)), unit in VAGUE


UNIT_SCHEMA = "unit_name string, unit string, dimension string, metric double, vague boolean"


def unit_table(spark: SparkSession) -> DataFrame:
    """unit_name (folded), unit, dimension, metric (grams or millilitres, null for counts), vague."""
    return spark.createDataFrame([unit_row(n, u) for n, u in sorted(names().items())], UNIT_SCHEMA)


def unit_key(phrase: Column) -> Column:
    """A phrase as unit names are written in the table; full stops part words."""
    plain = F.translate(F.lower(phrase), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\.", " "), r"\s+", " "))


def named_runs(words: Column) -> Column:
    """The words, and pairs of neighbours, of an array that name a unit; others are dropped in place, and pairs joined only after a first word of some name."""
    known = sorted(names())
    single, double = [n for n in known if " " not in n], [n for n in known if " " in n]
    first = sorted({n.split(" ")[0] for n in double})
    pair = lambda a, b: F.when(a.isin(first), F.concat(a, F.lit(" "), b))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), pair)
    return F.concat(F.filter(words, lambda w: w.isin(single)), F.filter(pairs, lambda p: p.isin(double)))


def with_unit(df: DataFrame, phrase: str) -> DataFrame:
    """``df`` with unit, dimension, metric and vague of the unit that column ``phrase`` names, or nulls."""
    return df.withColumn("unit_name", unit_key(F.col(phrase))).join(F.broadcast(unit_table(df.sparkSession)), "unit_name", "left").drop("unit_name")
