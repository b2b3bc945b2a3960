"""Near-duplicates by DartMinHash signatures, banding, exact checks and connected classes.

Every element of a weighted set owns regions (unit layers of its weight), and hashed darts fall on them
in order of rank. Each dart carries a coordinate; a signature keeps the earliest dart of each. Darts later
than about log k / weight are never thrown, so a signature costs the number of elements plus k log k
rather than their product. Two sets agree in a coordinate with a probability of their weighted Jaccard
similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.llm.common import cut, free_names, text_of

CACHED_WORDS = 400_000
CHUNK_CHARS = 2_000_000
_U = np.uint64
#: Sizes of one class differ by at most this factor.
SIZE_STEP = 1.05


def mixed(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """64-bit integers, well mixed (the finaliser of splitmix64)."""
    x = x + (salt * _U(0x9E3779B97F4A7C15) if isinstance(salt, np.ndarray) else _U((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct runs of ``n`` words; fewer words than that are one run."""
    n = min(n, len(words))
    if not n:
        return words
    h = np.zeros(len(words) - n + 1, "u8")
    for j in range(n):
        h = h * _U(0x100000001B3) + words[j : j + len(h)]
    return np.unique(mixed(h, n))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """Signatures (n_sets, k) of weighted sets; element i has ``weights[i]`` > 0 in set ``owner[i]``.

    Sets without elements get zeros.
    """
    layers = np.ceil(weights).astype("i8")
    layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
    keys, owner = mixed(np.repeat(elements, layers) + layer.astype("u8") * _U(0xD6E8FEB86659FD93), 1), np.repeat(owner, layers)
    room = np.minimum(np.repeat(weights, layers) - layer, 1.0)  # of the region that the weight covers
    total = np.bincount(owner, room, n_sets)
    latest = (np.log(k) + 4) / np.maximum(total, 1e-9)
    out = np.zeros((n_sets, k), "u8")
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.flatnonzero(np.isin(owner, todo))
        rank = np.zeros(len(mine))
        found = []
        dart, at_once = 0, 4
        while len(mine):
            # So many darts of each region at a time, more as only light sets are left, which take many.
            number = np.arange(dart, dart + at_once, dtype="u8") * _U(3)
            key = keys[mine][:, None]
            h = mixed(key, number + _U(2))
            ranks = rank[:, None] + np.cumsum(-np.log(((h >> _U(11)).astype("f8") + 0.5) * 2.0**-53), 1) / k
            early = ranks <= latest[owner[mine]][:, None]
            region, column = np.nonzero(early)
            name = mixed(keys[mine[region]], number[column] + _U(3))
            hit = ((mixed(keys[mine[region]], number[column] + _U(4)) >> _U(11)).astype("f8") * 2.0**-53) < room[mine[region]]
            found.append((owner[mine[region]][hit] * k + (name[hit] % _U(k)).astype("i8"), ranks[region, column][hit], name[hit]))
            going = early[:, -1]
            mine, rank = mine[going], ranks[going, -1]
            dart, at_once = dart + at_once, min(2 * at_once, 256)
        place, rank, name = (np.concatenate(x) for x in zip(*found, strict=True))
        # One sort by place, then rank: no rank is above its set's latest, so a share of that fits below the place.
        share = rank / latest[place // k] * 2.0**31
        order = np.argsort((place.astype("u8") << _U(32)) | np.minimum(share, 2.0**32 - 1).astype("u8"), kind="stable")
        place = place[order]
        at = np.flatnonzero(np.diff(place, prepend=-1))
        out.reshape(-1)[place[at]] = name[order[at]] | _U(1)
        todo = todo[(out[todo] == 0).any(1)]
        latest[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(signatures), bands), "u8")
    for j in range(rows):
        h = mixed(h * _U(31) + signatures[:, j : bands * rows : rows], 5)
    return mixed(h + np.arange(bands, dtype="u8"), 6).view("i8")


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of anything but ASCII white space."""
    return text.split()


def _node(text: Column) -> Column:
    """128 bits that name a text."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def banded(docs: DataFrame, shingle: int, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node and the band keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            done = 0
            while done < whole.num_rows:
                sets, n = [], 0
                while done + len(sets) < whole.num_rows and n < CHUNK_CHARS:
                    text = whole.column(2)[done + len(sets)].as_py()
                    n += len(text)
                    sets.append(shingle_hashes(hashes.of(words_of(text)), shingle))
                sizes = [len(s) for s in sets]
                elements = np.concatenate(sets)
                signatures = dart_signatures(elements, np.ones(len(elements)), np.repeat(np.arange(len(sets)), sizes), len(sets), k)
                keys = band_keys(signatures, bands, rows)
                lists = [keys[i].tolist() if sizes[i] else [] for i in range(len(sets))]
                part = whole.slice(done, len(sets))
                done += len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    text = text_of().cast("binary")
    return docs.select("doc_id", _node(text).alias("node"), text.alias("text")).mapInArrow(run, "doc_id long, node binary, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' runs of words have a Jaccard similarity of ``threshold`` or more."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        def runs(t: bytes) -> set:
            w = words_of(t)
            return set(zip(*(w[j:] for j in range(min(shingle, len(w)))), strict=False)) if w else set()

        out, last, mine = [], None, set()
        for x, y in zip(left, right, strict=True):
            if x is not last:
                last, mine = x, runs(x)
            other = runs(y)
            common = len(mine & other)
            out.append(bool(mine) and common >= threshold * (len(mine) + len(other) - common) - 1e-9)
        return pd.Series(out, dtype="bool")

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.where(alike("text_a", "text_b")).select("a", "b")


def shingles_of(texts: DataFrame, shingle: int) -> DataFrame:
    """node, size, shingle: every distinct run of words of each text, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for i in range(whole.num_rows):
                found = shingle_hashes(hashes.of(words_of(whole.column(1)[i].as_py())), shingle).view("i8")
                node = pa.array([whole.column(0)[i].as_py()] * len(found), pa.binary())
                yield pa.RecordBatch.from_arrays([node, pa.array(np.full(len(found), len(found))), pa.array(found)], ["node", "size", "shingle"])

    return texts.select("node", "text").mapInArrow(run, "node binary, size long, shingle long")


def _overlap(mine: Column, other: Column, threshold: float) -> Column:
    """How many elements two sets of these sizes have in common at least if they are similar."""
    return F.ceil((mine + other) * F.lit(threshold / (1 + threshold)) - 1e-6)


def prefix_pairs(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Every pair (a, b) of nodes that can be similar, by prefix filtering; texts: node, label, open, text.

    A set's elements are ordered by how many sets hold them, rare ones first. Similar sets must share
    an element among the first few, as many as may be missing from the other, and the places where they do
    leave room for the rest of the overlap. Only pairs with an open text and of two labels are of
    interest. A set is looked up once for every class of sizes that a similar but no larger set can
    have, with the prefix that this class needs, so that a common element costs little.
    """
    found = cut(shingles_of(texts, shingle))
    shared = found.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    held = found.join(shared, "shingle").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    held = held.join(texts.select("node", "label", "open"), "node")
    # Elements that no other set holds come first; they can't be shared, but they use up the prefix.
    alone = F.col("size") - F.size("held")
    placed = F.transform("held", lambda x, i: F.struct(x["shingle"].alias("shingle"), (alone + i).alias("place")))
    step = math.log(SIZE_STEP)
    size_class = lambda size: F.floor(F.log(size.cast("double")) / step).cast("int")
    held = cut(held.select("node", "label", "open", "size", placed.alias("placed")))
    indexed = held.select("node", "label", "open", "size", size_class(F.col("size")).alias("class"), F.explode(F.filter("placed", lambda x: x["place"] <= F.col("size") - _overlap(F.col("size"), F.col("size"), threshold))).alias("x"))
    indexed = indexed.select(F.col("node").alias("b"), F.col("label").alias("b_label"), F.col("open").alias("b_open"), F.col("size").alias("b_size"), "class", "x.shingle", F.col("x.place").alias("b_place"))
    least = F.greatest(F.ceil(F.col("size") * threshold - 1e-6), F.lit(1))
    probes = held.withColumn("class", F.explode(F.sequence(size_class(least), size_class(F.col("size")))))
    lowest = F.greatest(least, F.ceil(F.exp(F.col("class") * step) - 1e-6))
    probes = probes.select("node", "label", "open", "size", "class", F.explode(F.filter("placed", lambda x: x["place"] <= F.col("size") - _overlap(F.col("size"), lowest, threshold))).alias("x"))
    probes = probes.select(F.col("node").alias("a"), F.col("label").alias("a_label"), F.col("open").alias("a_open"), F.col("size").alias("a_size"), "class", "x.shingle", F.col("x.place").alias("a_place"))
    room = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) >= _overlap(F.col("a_size"), F.col("b_size"), threshold)
    smaller = (F.col("b_size") < F.col("a_size")) | ((F.col("b_size") == F.col("a_size")) & (F.col("b") < F.col("a")))
    meet = probes.join(indexed, (probes["shingle"] == indexed["shingle"]) & (probes["class"] == indexed["class"]) & (F.col("a_label") != F.col("b_label")) & (F.col("a_open") | F.col("b_open")) & smaller & room)
    return meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that each linked node can reach.

    Each round takes the least label among a node's neighbours and then the label of its label, so the
    number of rounds grows with the logarithm of a class's width. Nothing is collected but a count.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    edges = cut(both.distinct())
    labels = cut(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        around = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = cut(nearer.join(jump, "label").select("node", "old", F.least("label", "beyond").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old != label").isEmpty():
            return labels


def near_classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, k: int = 125, bands: int = 25) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size,
    and ``node`` and ``root``, which name the text and the class.

    Documents are in one class if a chain of texts leads from one to the other, each step with a Jaccard
    similarity of at least ``threshold`` between the sets of runs of ``shingle`` words (a shorter text is one
    run). Equal texts are one node from the start. Null counts as empty text; texts without words are only
    like their equals. A null doc_id never names a class unless no other is there; repeated rows are each
    kept. Pairs come from bands of the signature: at 0.8 and the given numbers a pair meets in some band
    with a probability of 0.99995, and every pair that meets is decided exactly or is in one class
    anyway. To that end, a band's texts are first held against two of them, the best connected and the
    least; what isn't in one class after that is held against each text of the bucket that it isn't
    connected with, as far as a prefix of its rarest runs of words allows for similarity at all.
    """
    rows = cut(banded(docs, shingle, k, bands, k // bands))
    members = rows.select("node", F.explode("keys").alias("bucket")).groupBy("bucket", "node").agg(F.lit(1).alias("one")).drop("one")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(members.join(sizes, "bucket"))
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = shared.join(degrees, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"), F.min("node").alias("least"))
    led = cut(shared.select("bucket", "node").join(leaders, "bucket"))
    pairs = led.select(F.explode(F.array("hub", "least")).alias("leader"), "node").where("leader != node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    texts = docs.select(_node(text_of()).alias("node"), text_of().cast("binary").alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    links = cut(similar(pairs, texts, shingle, threshold))
    labels = components(links)

    labelled = cut(led.join(labels, "node", "left").select("bucket", "node", "hub", "least", F.coalesce("label", "node").alias("label")))
    mains = labelled.where("node = hub").select("bucket", F.col("label").alias("main"))
    others = labelled.where("node != hub and node != least").join(mains, "bucket").withColumn("open", F.expr("label != main"))
    mixed_up = others.groupBy("bucket").agg(F.max("open").alias("some"), F.min("label").alias("low"), F.max("label").alias("high")).where("some and low != high").select("bucket")
    left = cut(others.join(mixed_up, "bucket").groupBy("node").agg(F.first("label").alias("label"), F.max("open").alias("open")))
    if not left.isEmpty():
        # Few texts are left, so they are looked up among the documents again rather than all carried along.
        told = docs.select(_node(text_of()).alias("node"), text_of().cast("binary").alias("text")).join(left, "node").groupBy("node").agg(F.first("label").alias("label"), F.first("open").alias("open"), F.first("text").alias("text"))
        told = cut(told)
        more = cut(similar(prefix_pairs(told, shingle, threshold), told.select("node", "text"), shingle, threshold))
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    rooted = rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rooted.join(classes, "root").select("doc_id", "class_id", "class_size", "node", "root")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, that of the least doc_id (of equals, of the least text hash)."""
    name = free_names(docs, "pick", "number")
    # One key names a row's id and text, so that the rows are dealt out once for the join and for the choice.
    pick = lambda node, doc_id: F.concat(node, F.when(F.col(doc_id).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(doc_id).cast("string"))).cast("binary")).alias(name["pick"])
    kept = near_classes(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.first("class_id").alias("class_id"), F.min("node").alias("node"))
    rows = docs.select("*", pick(_node(text_of()), "doc_id"))
    found = rows.join(kept.select(pick(F.col("node"), "class_id")), name["pick"], "left_semi")
    number = F.row_number().over(Window.partitionBy(name["pick"]).orderBy(F.xxhash64(*(docs[c] for c in docs.columns))))
    return found.withColumn(name["number"], number).where(F.col(name["number"]) == 1).select(*docs.columns)
