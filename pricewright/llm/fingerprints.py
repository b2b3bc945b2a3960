"""Canonical exact digest of documents.

Texts are brought to one form (compatibility decomposition, full case folding, recomposition, white
space runs to one space), hashed to 128 bits with two chained xxhash64 values, and grouped by that
hash. Inside a bucket that holds more than one row the canonical bytes themselves are compared, so
that a fingerprint names exactly one canonical text: were two texts ever to share a hash, the later
one in byte order gets an ordinal behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.llm.common import cut, partitions, text_of

_ICU = "com.ibm.icu.text.Normalizer"
_FOLD = "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """The one form of a text: NFKC of the case-folded NFKD, white space folded and trimmed.

    ICU is part of Spark itself and is called through the SQL function ``java_method``. ASCII texts
    need no more than lower case. Null gives the empty text.
    """
    text = F.coalesce(text, F.lit(""))
    folded = F.java_method(F.lit(_FOLD), F.lit("foldCase"), F.java_method(F.lit(_ICU), F.lit("decompose"), text, F.lit(True)), F.lit(True))
    composed = F.java_method(F.lit(_ICU), F.lit("compose"), folded, F.lit(True))
    one_case = F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(one_case, r"[\p{Z}\x09-\x0D\x1C-\x1F\x85]+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits: xxhash64 of the text, and xxhash64 seeded by another value."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def fingerprint(rows: DataFrame, key: str, ordinal: str, texts: list[str], carried: list[Column] = ()) -> DataFrame:
    """Fingerprints of several text columns of each row.

    ``key`` and ``ordinal`` together name a row; rows should already lie by ``key``, as then no text
    moves for the hashes. Returns key, ordinal and one column ``<text>_fingerprint`` per text column.
    Null texts count as empty; equal canonical texts get equal fingerprints wherever they stand; an
    empty table gives an empty one. Only hashes are shuffled, except for texts of buckets with
    several rows: each distinct one is sent once per task that holds it, for the byte comparison.
    """
    forms = rows.select(key, ordinal, *(canonical(F.col(t)).alias(t) for t in texts))
    hashed = rows.select(key, ordinal, *carried, *(wide_hash(canonical(F.col(t))).alias(t) for t in texts)).repartition(F.col(key))
    items = hashed.select(key, ordinal, F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(f"{t}.h1"), F.col(f"{t}.h2")) for i, t in enumerate(texts)))).alias("x")).select(key, ordinal, "x.*")
    shared = items.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    wanted = items.join(shared, ["h1", "h2"]).groupBy(key, ordinal).agg(F.collect_set("which").alias("wanted"))
    there = wanted.select(F.col(key).alias("_k"), F.col(ordinal).alias("_o"), "wanted")
    # The ordinal is compared as a plain condition, so that both sides may stay dealt out by the key alone.
    held = forms.join(there, (F.col(key) == F.col("_k")) & (F.col(ordinal) - F.col("_o") == 0))
    members = held.select(key, ordinal, F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("which"), F.col(t).alias("form")) for i, t in enumerate(texts))), lambda x: F.array_contains(F.col("wanted"), x["which"]))).alias("x"))
    members = members.select(key, ordinal, "x.which", "x.form", wide_hash(F.col("x.form")).alias("h")).select(key, ordinal, "which", "form", "h.h1", "h.h2")
    distinct = members.groupBy("h1", "h2", "form").agg(F.lit(1).alias("one"))
    clashes = distinct.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    ranked = distinct.join(clashes, ["h1", "h2"]).withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("form")) - 1)
    later = ranked.where("rank > 0").select("h1", "h2", "form", "rank")
    moved = members.join(later, ["h1", "h2", "form"]).groupBy(key, ordinal).agg(F.map_from_entries(F.collect_list(F.struct("which", "rank"))).alias("ranks"))
    moved = moved.select(F.col(key).alias("_k"), F.col(ordinal).alias("_o"), "ranks")

    def name(i: int, t: str) -> Column:
        rank = F.element_at(F.coalesce(F.col("ranks"), F.create_map().cast("map<int,int>")), F.lit(i))
        digits = F.format_string("%016x%016x", F.col(f"{t}.h1"), F.col(f"{t}.h2"))
        return F.when(rank.isNull(), digits).otherwise(F.concat(digits, F.lit("-"), rank.cast("string")))

    out = hashed.join(moved, (F.col(key) == F.col("_k")) & (F.col(ordinal) - F.col("_o") == 0), "left")
    rest = [c for c in hashed.columns if c not in (key, ordinal, *texts)]
    return out.select(key, ordinal, *rest, *(name(i, t).alias(f"{t}_fingerprint") for i, t in enumerate(texts)))


def successors(docs: DataFrame) -> DataFrame:
    """For every row (``k``, ``ordinal``) the row that follows in ascending (k, ordinal); after the last, the first.

    Rows are dealt out by ranges of ``k`` and each range is sorted by itself; what follows the last
    row of a range is the first of the next, taken from a table of one row per range.
    """
    n = partitions(docs.sparkSession)
    ranged = cut(docs.repartitionByRange(n, "k").withColumn("range", F.spark_partition_id()))
    ranged = ranged.withColumn("ordinal", F.row_number().over(Window.partitionBy("range", "k").orderBy("text_hash")))
    order = Window.partitionBy("range").orderBy("k", "ordinal")
    ranged = ranged.withColumn("after", F.lead(F.struct("k", "ordinal")).over(order))
    firsts = ranged.groupBy("range").agg(F.min("k").alias("k"))
    by_range = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("k").over(by_range), F.first("k").over(by_range)).alias("first_k"))
    # One row per range: at most as many as spark.sql.shuffle.partitions.
    out = ranged.join(F.broadcast(firsts), "range")
    after = F.coalesce(F.col("after"), F.struct(F.col("first_k").alias("k"), F.lit(1).alias("ordinal")))
    return out.select("k", "ordinal", "doc_id", "n_chars", after["k"].alias("next_k"), after["ordinal"].alias("next_ordinal"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are.

    The edited text has its last half replaced by the start of the next document's text, in ascending
    doc_id. Rows with one doc_id are each kept and follow one another by a hash of their text; a null
    doc_id comes first; a null text counts as empty. The digest is exact, so a likeness is 1 or 0.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k"), "doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    following = cut(successors(keyed.select("k", "doc_id", "text_hash", F.char_length("text").cast("long").alias("n_chars"))))
    placed = keyed.drop("doc_id").withColumn("ordinal", F.row_number().over(Window.partitionBy("k").orderBy("text_hash")))

    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = following.select(F.col("next_k").alias("_k"), F.col("next_ordinal").alias("_o"), F.col("k").alias("to_k"), F.col("ordinal").alias("to_o"), half.alias("half"))
    heads = placed.join(wanted, (F.col("k") == F.col("_k")) & (F.col("ordinal") - F.col("_o") == 0)).select("to_k", "to_o", "half", F.expr("substring(text, 1, half)").alias("head"))
    both = placed.join(heads, (F.col("k") == F.col("to_k")) & (F.col("ordinal") - F.col("to_o") == 0)).select("k", "ordinal", "text", F.expr("concat(substring(text, 1, char_length(text) - half), head)").alias("edited"))

    rows = fingerprint(both, "k", "ordinal", ["text", "edited"], [F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")])
    chain = following.select(F.col("k").alias("_k"), F.col("ordinal").alias("_o"), "doc_id", "n_chars", "next_k", "next_ordinal")
    rows = cut(rows.join(chain, (F.col("k") == F.col("_k")) & (F.col("ordinal") - F.col("_o") == 0)).drop("_k", "_o"))
    others = rows.select(F.col("k").alias("next_k"), F.col("ordinal").alias("next_ordinal"), F.col("text_fingerprint").alias("next_fingerprint"))
    rows = rows.join(others, ["next_k", "next_ordinal"])
    same = lambda other: (F.col("text_fingerprint") == F.col(other)).cast("double")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.col("text_fingerprint").alias("fingerprint"), "edited_fingerprint",
        same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"),
    )
