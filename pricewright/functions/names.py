"""Product-name folding, tokens and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: letters with marks and what they fold to.
MARKED, PLAIN = "ąčęėįšųūžàâäáçéèêëíîïñóôöòßúùûü", "aceeisuuzaaaaceeeeiiinoooosuuuu"
#: Fixed value: the chains' own names, as whole words.
CHAIN_PATTERN = r"\b(?:rimi|maxima|iki|lidl|norfa|smart|barbora)\b"


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def normal_name(text: Column) -> Column:
    """Folded, with anything but letters, digits and plus as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"[^a-z0-9+]+", " "), " +", " "))


def cross_chain_name(text: Column) -> Column:
    """Folded, without the chains' own names but with all numbers, so that pack sizes still tell names apart."""
    plain = F.regexp_replace(F.regexp_replace(folded(text), CHAIN_PATTERN, " "), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def without_sizes(text: Column) -> Column:
    """A normal name without amounts and their units."""
    return F.trim(F.regexp_replace(normal_name(F.regexp_replace(folded(text), r"\d+(?:[.,]\d+)?\s*(?:%|(?:kg|g|l|ml|vnt|pak|rit)\b)", " ")), " +", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normal_name(text), " "), lambda t: t != "")


def significant_tokens(text: Column) -> Column:
    """Distinct tokens of four letters or more that hold a letter."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 4) & t.rlike("[a-z]")))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the name with two spaces on either side."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 2), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer name; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(both / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens as a share of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def contains_all(text: Column, query: str) -> Column:
    """True if every token of ``query`` is somewhere in the folded text; an empty query is always true."""
    out = F.lit(True)
    for token in query.lower().split():
        out = out & F.contains(folded(text), folded(F.lit(token)))
    return out


def user_name_verdict(name: Column, least: int = 3, most: int = 20) -> Column:
    """'ok', or why a user name isn't taken: only small letters, digits, dots and underlines after trimming and lowering."""
    t = F.lower(F.trim(name))
    return F.when(F.length(t) < least, "too-short").when(F.length(t) > most, "too-long").when(t.rlike("^[a-z0-9_.]+$"), "ok").otherwise("bad-format")


def walked(paths: DataFrame, nodes: DataFrame, key: str, depth: int = 4) -> DataFrame:
    """Where each path of normal names leads in a tree: key and ``found``.

    ``paths`` has key and ``path``, ``nodes`` id, parent, name. Names are followed from the roots as far as they go
    (``depth`` levels); a path of which not even the first is a root ends at the first node (by id) that is called
    like its last name, or nowhere (null). An empty or null path leads nowhere.
    """
    roots = nodes.where("parent is null").select(F.col("name").alias("_name"), F.col("id").alias("_next")).groupBy("_name").agg(F.min("_next").alias("_next"))
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("_found"), F.col("name").alias("_name")).agg(F.min("id").alias("_next"))
    at = paths.withColumn("_name", F.get("path", 0)).join(roots, "_name", "left").select(key, "path", F.col("_next").alias("_found"), F.col("_next").isNotNull().alias("_going"))
    for level in range(1, depth):
        step = at.withColumn("_name", F.when(F.col("_going"), F.get("path", level))).join(below, ["_found", "_name"], "left")
        at = step.select(key, "path", F.coalesce("_next", "_found").alias("_found"), F.col("_next").isNotNull().alias("_going"))
    flat = nodes.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_any"))
    last = F.when(F.col("_found").isNull() & (F.size("path") > 0), F.element_at("path", -1))
    return at.withColumn("_name", last).join(flat, "_name", "left").select(key, F.coalesce("_found", "_any").alias("found"))
