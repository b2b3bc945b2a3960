"""Word stems: what is left of a folded word without its ending, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions.names import MARKED, PLAIN

# The endings that each kind of stem goes without.
QUERY_ENDINGS = (
    "iausias iausia iesiems uosius iams iais iose iuos ioms ams ais oms ems uose yse ose ese ios ius iai iam iui ims "
    "as is us ys os es ai ei io iu ia ui ie a e i o u y s"
).split()
MATCH_ENDINGS = (
    "iams iais iose uose emis omis umis imis ams ais oms ems ose yse ese ius ios ies iai iui iam yje oje eje "
    "ui io iu os es us ys as is ai ei a e i o u y"
).split()
RECIPE_ENDINGS = (
    "iaisiais osiomis iesiems osioms aisiais osios iosios ųjų ajam ojo oji uoju ąją asis ieji ojoje "
    "iomis iams iais omis ėmis iuose uose ose yje ams ais ius ies ėje oje ėms iai iui iu ai ui us os as is ys ės ių "
    "ų ę į ą ė a e i o u y"
).split()
CATEGORY_ENDINGS = "iams omis ėmis iais uose ose ams ais ius iai ios ies iui io ia is ys as us os es ės ai ą ę į ų ū ė a e i o u y".split()


def ending_pattern(endings: list[str], least_stem: int) -> str:
    """A pattern whose first group is a word without the longest ending that leaves ``least_stem`` letters.

    The group is lazy, so it ends where the longest of the (folded) endings begins.
    """
    fold = str.maketrans(MARKED, PLAIN)
    return f"^(.{{{least_stem},}}?)(?:{'|'.join(dict.fromkeys(e.translate(fold) for e in endings))})$"


QUERY_STEM = ending_pattern(QUERY_ENDINGS, 3)
MATCH_STEM = ending_pattern(MATCH_ENDINGS, 4)
RECIPE_STEM = ending_pattern(RECIPE_ENDINGS, 3)
CATEGORY_STEM = ending_pattern(CATEGORY_ENDINGS, 0)


def query_stem(word: Column) -> Column:
    """For searches: one ending off, three letters left at least."""
    return F.regexp_replace(word, QUERY_STEM, "$1")


def match_stem(word: Column) -> Column:
    """For matching: one ending off words of six letters or more, four left at least."""
    return F.when(F.length(word) < 6, word).otherwise(F.regexp_replace(word, MATCH_STEM, "$1"))


def recipe_stem(word: Column) -> Column:
    """For ingredients: one ending (those of definite adjectives too) off, three letters left at least."""
    return F.regexp_replace(word, RECIPE_STEM, "$1")


def english_singular(word: Column) -> Column:
    """Without the plural's s; words of under four letters or in -ss stay."""
    return F.when((F.length(word) >= 4) & word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", "")).otherwise(word)


def plain_recipe_stem(word: str) -> str:
    """``recipe_stem`` of one folded word."""
    return re.sub(RECIPE_STEM, r"\1", word)


def plain_english_singular(word: str) -> str:
    """``english_singular`` of one folded word."""
    return word[:-1] if len(word) >= 4 and word.endswith("s") and not word.endswith("ss") else word


def category_stem(word: Column) -> Column:
    """For heads of category names: one ending off, whatever is left."""
    return F.regexp_replace(word, CATEGORY_STEM, "$1")
