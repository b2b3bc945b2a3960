"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by a keyed hash, laid end to end, and cut into blocks of equally
many words. The mix is a row of slots, one per block. Slot times are the van der Corput points (bits
reversed) of the positions on a line where each source owns as many positions as it has blocks, so any
stretch of slots holds the sources nearly in their target shares. The slots of a source are ranked by
time, and slot number j takes block number j.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.llm.common import WORD, cut, text_of, word_count


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: ``source_id`` (its rank by code point, null last), size and target.

    The sources weigh ``weights``, repeating, and share ``share`` of all words; no target is above
    ``most`` times its source's size, and what is left over goes to the others by weight until none is
    above. Each round of that is one aggregate of two numbers. There is one row per source, so the
    ranking sorts the list of sources, not their documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranked = sources.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("source_id") - 1) % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * most))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        held, open_weight = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        rising = (total - (held or 0)) / open_weight if open_weight else level
        if rising <= level:
            break
        level = rising
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * level)).drop("weight", "most")


def van_der_corput(position: Column, bits: int) -> Column:
    """The position with its ``bits`` binary digits reversed: its place in the sequence, in whole steps."""
    if bits == 0:
        return F.lit(0).cast("long")
    return F.conv(F.reverse(F.lpad(F.bin(position), bits, "0")), 2, 10).cast("long")


def schedule(blocks: DataFrame, buckets: int) -> DataFrame:
    """Slots ``slot``, ``source_id``, ``rank`` for a table of ``source_id``, ``n_blocks``.

    The positions are a distributed range; each finds its source through the cumulative block counts,
    joined by stretches of the line. Ranks add a count per stretch of time to the rank inside it, so
    that a source with most of the slots isn't ranked in one task.
    """
    spark = blocks.sparkSession
    line = cut(blocks.withColumn("to", F.sum("n_blocks").over(Window.orderBy("source_id"))).withColumn("from", F.col("to") - F.col("n_blocks")))
    total = line.agg(F.max("to")).first()[0] or 0
    bits = max(total - 1, 0).bit_length()
    step = max(1, total // buckets)
    owned = line.where("n_blocks > 0").select("source_id", "from", "to", F.explode(F.expr(f"sequence(`from` div {step}, (`to` - 1) div {step})")).alias("stretch"))
    positions = spark.range(total).select(F.col("id").alias("position"), F.expr(f"id div {step}").alias("stretch"))
    slots = positions.join(owned, "stretch").where("position >= from and position < to").select("source_id", van_der_corput(F.col("position"), bits).alias("slot"))
    slots = slots.withColumn("era", F.expr(f"slot div {max(1, (1 << bits) // buckets)}"))
    eras = slots.groupBy("source_id", "era").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_id").orderBy("era")) - F.col("n")
    ranked = slots.join(eras.withColumn("before", before).drop("n"), ["source_id", "era"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source_id", "era").orderBy("slot")) - 1
    return ranked.select("slot", "source_id", rank.alias("rank"))


def shuffled(sized: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """The documents with their place ``start`` in their source's shuffled stream of words.

    A source's order is by hash bucket, then hash; the words before a bucket come from a sum per
    bucket, those before a document from a running sum inside it. With the square root of the number of
    documents as the number of buckets neither grows faster than that root.
    """
    documents = targets.agg(F.sum("documents")).first()[0] or 0
    buckets = max(1, math.isqrt(documents))
    placed = sized.join(targets.drop("documents"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    sums = placed.groupBy("source_id", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("bucket_from", F.sum("words").over(Window.partitionBy("source_id").orderBy("bucket")) - F.col("words")).drop("words")
    inside = Window.partitionBy("source_id", "bucket").orderBy("hash", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(sums, ["source_id", "bucket"]).withColumn("at", F.row_number().over(inside))
    return placed.withColumn("start", F.col("bucket_from") + F.sum("size").over(inside) - F.col("size")).drop("bucket_from"), buckets


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 2048, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents: (placed documents, pieces).

    A piece is the part of one document in one slot: ``slot``, ``epoch``, the document's ``source_id``,
    ``bucket``, ``at``, and the words ``piece_start`` (from 0) and ``piece_words``. Ordered by slot and
    ``block_offset`` the pieces are the mixture. Source names may be null; texts that are null or
    hold no word have size 0 and no piece; a source without words gets no target. Repeated rows are
    documents of their own. An empty table gives empty results. Reruns agree, as every choice is a
    hash of ids and of ``seed``.
    """
    sized = cut(docs.select("doc_id", "source", word_count(text_of()).alias("size")).withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "size")))
    targets = cut(source_targets(sized, weights, share, most))
    placed, buckets = shuffled(sized, targets)
    placed = cut(placed)
    words = F.floor(F.col("target") + 0.5)
    slots = schedule(targets.select("source_id", F.ceil(words / block).alias("n_blocks")), buckets)
    passes = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("begin", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), words)).where("begin < end")
    pieces = passes.withColumn("rank", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})")))
    lo, hi = F.greatest(F.col("begin"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    pieces = pieces.select("source_id", "bucket", "at", "rank", "epoch", (lo - F.col("begin")).alias("piece_start"), (hi - lo).alias("piece_words"), (lo - F.col("rank") * block).alias("block_offset"))
    return placed, pieces.join(slots, ["source_id", "rank"])


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document how many of its words the mix takes, repeats counted."""
    placed, pieces = mix(docs, **options)
    sums = pieces.groupBy("source_id", "bucket", "at").agg(F.sum("piece_words").alias("taken"))
    out = placed.join(sums, ["source_id", "bucket", "at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: one row per stretch of a document in the mix, columns as in ``docs``.

    Pieces of one document in one epoch that follow one another in the stream are one stretch again,
    so a document that is taken whole comes back unchanged, once per epoch. The text of a part is that
    run of words with the white space behind each. Documents that the mix does not take are left out.
    """
    placed, pieces = mix(docs, **options)
    stretches = pieces.groupBy("source_id", "bucket", "at", "epoch").agg(F.min("piece_start").alias("first_word"), F.sum("piece_words").alias("n_words"))
    same = ["_id", "_source", "_size"]
    rows = placed.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "source_id", "bucket", "at")
    # Rows that agree in id, source and size are told apart by number, on both sides.
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy("at"))).join(stretches, ["source_id", "bucket", "at"])
    # The document rides along as one struct, so none of its columns can clash.
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(text_of()).alias("_size"))
    whole = whole.withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(F.col("_row")["text"]))))
    matches = whole["_id"].eqNullSafe(rows["_id"]) & whole["_source"].eqNullSafe(rows["_source"]) & (whole["_size"] == rows["_size"]) & (whole["_copy"] == rows["_copy"])
    text = F.col("_row")["text"]
    units = F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.col("first_word").cast("int") + 1, F.col("n_words").cast("int"))
    new = {"text": F.when((F.col("first_word") == 0) & (F.col("n_words") == whole["_size"]), text).otherwise(F.array_join(units, ""))}
    new["n_chars"] = F.char_length(new["text"]).cast("long")
    return whole.join(rows, matches).select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
