"""Repeated passages, found exactly with an FM-index per shard.

A window of ``length`` words has an anchor, the least hash of a run of ``GRAM`` words in it; equal windows
have equal anchors. Consecutive windows with one anchor make up a segment, and all segments of an
anchor go to one shard, so whatever equals a window is in that window's shard. (An anchor that is
very frequent has several shards; a segment goes to those that the hashes of its windows name.) A
shard puts its distinct segments into an FM-index (Burrows-Wheeler transform in a wavelet tree of
packed bits) and streams them through it: backward search extends a segment's end to the left for as
long as the match occurs elsewhere, which gives the matching statistics and so the repeated intervals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.common import partitions, shared_folder, text_of

GRAM = 6
#: An anchor that occurs more often has a shard for every so many occurrences.
HOT_ANCHOR = 20_000
#: Anchors, repeated or not, for which there is one shard.
SHARD_ANCHORS = 100_000
CACHED_WORDS = 400_000
#: Segments that a task remembers so as to send equal ones on only once.
CACHED_SEGMENTS = 100_000
#: Texts are handled in batches of so many bytes.
CHUNK_BYTES = 4_000_000
_U = np.uint64


class Hashes:
    """64-bit hashes of words, which are UTF-8 without ASCII white space."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), "u8", len(words))


def _of_runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, from hashes of runs half as long."""
    h, done = words, 1
    while done < width:
        step = min(done, width - done)
        h = (h[:-step] * _U(0x9E3779B97F4A7C15)) ^ h[step:]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        done += step
    return h


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def segments(words: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of texts of so many words laid end to end.

    Returns text number, anchor, first word, end (exclusive), and how often the anchor occurs in the segment.
    """
    if len(words) < length:
        return (np.zeros(0, "i8"),) * 5
    gram = min(GRAM, length)
    width = length - gram + 1
    runs = _of_runs(words, gram)
    least = _least_of(runs, width)
    offset = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + length <= (offset + sizes)[owner])
    owner, least = owner[window], least[window]
    if not len(window):
        return (np.zeros(0, "i8"),) * 5
    starts = np.ones(len(window), bool)
    starts[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    # Of one anchor that recurs again and again come many windows; they are cut into segments of bounded length.
    first = np.flatnonzero(starts)
    starts |= (window - window[first][np.cumsum(starts) - 1]) % length == 0
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(window)) - 1
    anchor = least[first]
    n = np.add.reduceat((runs[window] == least).astype("i8"), first)
    n += (runs[window[last][:, None] + np.arange(1, width)] == anchor[:, None]).sum(1)
    at = offset[owner[first]]
    return owner[first], anchor.view("i8"), window[first] - at, window[last] + length - at, n


class WaveletTree:
    """Bits of symbols, level by level, in 64-bit words with running counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        rows = symbols
        for b in reversed(range(bits)):
            ones = (rows >> b) & 1 == 1
            packed = np.zeros((len(rows) // 64 + 1) * 8, "u1")
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view("u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype="i8")[:-1]])
            self.levels.append((packed, counts, int(len(rows) - ones.sum())))
            rows = np.concatenate([rows[~ones], rows[ones]])
        symbols = np.arange(1 << bits)
        self.origin = self._sink(symbols, np.zeros(len(symbols), "i8"))

    def _sink(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place comes to lie below the last level, as seen by each symbol."""
        for level, (packed, counts, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            word = at >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((_U(1) << (at & 63).astype("u8")) - _U(1)))
            at = np.where((symbols >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place ``upto``."""
        return self._sink(symbols, upto) - self.origin[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        """``text`` of symbols below ``n_symbols``, sorted by the first ``depth`` symbols of each suffix."""
        n, bits = len(text), max(1, int(n_symbols - 1).bit_length())
        k = 62 // bits  # symbols that fit in one number
        key = text.astype("i8")
        for j in range(1, k):
            key = (key << bits) | np.concatenate([text[j:], np.zeros(min(j, n), "i8")])
        while True:
            order = np.argsort(key)
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if k >= depth or step[-1] == n - 1:
                break
            rank = np.empty(n, "i8")
            rank[order] = step
            key = rank * (int(step[-1]) + 2) + np.concatenate([rank[k:] + 1, np.zeros(min(k, n), "i8")])
            k *= 2
        self.size = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.tree = WaveletTree(text[order - 1], bits)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the symbols put in front of the matches in [lo, hi)."""
        at = self.before[symbols]
        ranks = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        return at + ranks[: len(symbols)], at + ranks[len(symbols) :]

    def reach(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, need: int) -> np.ndarray:
        """How far to the left, but not before ``begin``, the match that ends at ``end`` occurs ``need`` times or more."""
        left, lo, hi = end.copy(), np.zeros(len(end), "i8"), np.full(len(end), self.size)
        alive = np.flatnonzero(left > begin)
        while len(alive):
            l2, h2 = self.extend(words[left[alive] - 1], lo[alive], hi[alive])
            good = h2 - l2 >= need
            alive = alive[good]
            lo[alive], hi[alive] = l2[good], h2[good]
            left[alive] -= 1
            alive = alive[left[alive] > begin[alive]]
        return left


def repeated_intervals(index: FMIndex, words: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, need: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which stretches of at least ``length`` words in each segment occur ``need`` times or more.

    Segment i is words[begin[i]:end[i]]. Returns segment, start and end in ``words``. All windows of a short
    segment share its middle; where the match that ends with the middle starts, the first window can start.
    From each end the match then grows to the left until it would be too rare; the next end worth trying is
    the one of the window that starts where growth stopped.
    """
    found: list[tuple] = [(np.zeros(0, "i8"),) * 3]
    middle = end - begin < 2 * length
    low = np.where(middle, index.reach(words, begin, np.where(middle, begin + length, begin), need), begin)
    who = np.flatnonzero(low <= end - length)
    low, right, left = low[who], end[who], end[who].copy()
    lo, hi = np.zeros(len(who), "i8"), np.full(len(who), index.size)
    while len(who):
        l2, h2 = index.extend(words[left - 1], lo, hi)
        good = h2 - l2 >= need
        left, lo, hi = left - good, np.where(good, l2, lo), np.where(good, h2, hi)
        stopped = ~good | (left == low)
        hit = stopped & (right - left >= length)
        if hit.any():
            found.append((who[hit], left[hit], right[hit]))
        # Each that has stopped goes on from its next end while the others still grow.
        right = np.where(stopped, np.minimum(right - 1, left - 1 + length), right)
        going = ~stopped | ((left > low) & (right - low >= length))
        left, lo, hi = np.where(stopped, right, left), np.where(stopped, 0, lo), np.where(stopped, index.size, hi)
        who, low, right, left, lo, hi = (x[going] for x in (who, low, right, left, lo, hi))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search_shard(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """All repeated intervals of one shard: node, begin, end in words of that text.

    Rows with a segment are places where it starts; ``known`` says that it is repeated for sure and told
    so already. Rows without one are intervals found before and are passed on.
    """
    told = rows[rows["segment"].isna()]
    rows = rows[rows["segment"].notna()].drop_duplicates(["node", "begin"])
    kind, distinct = pd.factorize(rows["segment"])
    often = np.bincount(kind, minlength=len(distinct)) > 1
    sure = often.copy()
    sure[kind[rows["known"].to_numpy(bool)]] = True
    whole = rows[often[kind]]
    out = [told[["node", "begin", "end"]], whole[["node", "begin", "end"]]]
    if not sure.all():
        split = [s.split() for s in distinct]
        sizes = np.array([len(s) for s in split])
        codes = {w: i for i, w in enumerate(set(chain.from_iterable(split)), 1)}
        words = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), "i8", sizes.sum())
        end = np.cumsum(sizes)
        begin = end - sizes
        # The segments in a row, each closed by symbol 0.
        index = FMIndex(np.insert(words, end, 0), len(codes) + 1, int(sizes.max()) + 1)
        ask = np.flatnonzero(~sure)
        segment, start, stop = repeated_intervals(index, words, begin[ask], end[ask], length)
        segment = ask[segment]
        place = np.full(len(distinct), -1)
        place[kind] = np.arange(len(kind))
        found = rows.iloc[place[segment]]
        first = found["begin"].to_numpy()
        out.append(pd.DataFrame({"node": found["node"].to_numpy(), "begin": first + start - begin[segment], "end": first + stop - begin[segment]}))
    return pd.concat(out).astype({"begin": "int64", "end": "int64"})


def _node(text: Column) -> Column:
    """128 bits that name a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of about CHUNK_BYTES, and the words of each text (column ``text``) in them."""
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            words, n = [], 0
            while at + len(words) < whole.num_rows and n < CHUNK_BYTES:
                raw = whole.column(text)[at + len(words)].as_py()
                n += len(raw) + 1000
                words.append(raw.split())
            yield whole.slice(at, len(words)), words
            at += len(words)


PIECES = "node binary, begin long, end long, shard long, segment binary, known boolean"
PIECES_ARROW = pa.schema([("node", pa.binary()), ("begin", pa.int64()), ("end", pa.int64()), ("shard", pa.int64()), ("segment", pa.binary()), ("known", pa.bool_())])


class _Cutter:
    """One task's cutting of texts into the segments that may be repeated."""

    def __init__(self, length: int, shards: int):
        self.length, self.shards, self.hashes = length, shards, Hashes()
        self.seen: dict[bytes, list] = {}
        self.last = None

    def _any_shard(self, node: bytes) -> int:
        return int.from_bytes(node[:8], "big") % self.shards

    def _shards_of(self, anchor: int, blocks: int, windows: np.ndarray | None) -> list[int]:
        if blocks == 1:
            return [anchor % self.shards]
        return list({(anchor + 0x9E3779B97F4A7C15 * b) % self.shards for b in set((windows % _U(blocks)).tolist())})

    def cut(self, batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        """Pieces of a batch with columns doc_id, node, text, marks, copies.

        A segment that this task has met before isn't sent again: both places are repeated, which is told at once.
        """
        nodes, copies = batch.column(1).to_pylist(), batch.column(4).to_pylist()
        marks = batch.column(3).flatten()
        known, at = np.unique(marks.field(0).to_numpy(zero_copy_only=False), return_index=True)
        blocks = marks.field(1).to_numpy(zero_copy_only=False)[at]
        for i, node in enumerate(nodes):  # equal texts are met one after another; one of them is enough
            if node == self.last or copies[i] is None:
                texts[i] = []
            self.last = node
        sizes = np.array([len(t) for t in texts])
        words = self.hashes(list(chain.from_iterable(texts)))
        owner, anchor, first, end, _ = segments(words, sizes, self.length)
        place = np.minimum(np.searchsorted(known, anchor), max(len(known) - 1, 0))
        marked = known[place] == anchor if len(known) else np.zeros(len(anchor), bool)
        owner, anchor, first, end, blocks = owner[marked], anchor[marked], first[marked], end[marked], blocks[place[marked]]
        runs = _of_runs(words, self.length) if len(blocks) and blocks.max() > 1 else None
        offset = np.cumsum(sizes) - sizes
        if len(self.seen) > CACHED_SEGMENTS:
            self.seen.clear()
        out: list[tuple] = []
        for i, (o, a, f, e, b) in enumerate(zip(owner.tolist(), anchor.tolist(), first.tolist(), end.tolist(), blocks.tolist(), strict=True)):
            segment, node = b" ".join(texts[o][f:e]), nodes[o]
            met = self.seen.get(segment)
            if met is None:
                self.seen[segment] = [node, f, e, copies[o] > 1]
                windows = None if b == 1 else runs[offset[o] + f : offset[o] + e - self.length + 1]
                out += [(node, f, e, s, segment, copies[o] > 1) for s in self._shards_of(a, b, windows)]
            elif met[0] != node or met[1] != f:
                if not met[3]:
                    met[3] = True
                    out.append((*met[:3], self._any_shard(met[0]), None, True))
                out.append((node, f, e, self._any_shard(node), None, True))
        out += [(nodes[i], 0, len(t), self._any_shard(nodes[i]), None, True) for i, t in enumerate(texts) if t and copies[i] > 1]
        columns = zip(*out, strict=True) if out else [[]] * len(PIECES_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES_ARROW, strict=True)], schema=PIECES_ARROW)


def deduplicated(docs: DataFrame, length: int = 35) -> DataFrame:
    """Per document what is left without passages that occur elsewhere: doc_id, n_words, n_removed, kept.

    A word is removed if some window of ``length`` consecutive words that covers it starts anywhere else
    as well, in another document or in the same one. Windows are judged on the input. Equal texts
    are one text with a number of copies; null counts as empty, with no word; a text shorter than a
    window keeps all its words; repeated rows and null ids are kept; other columns are ignored. ``kept``
    is the words left, joined by one space. No text passes the driver; texts are shuffled once. The
    list of anchors is written to the cluster's shared folder.
    """
    spark = docs.sparkSession

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in _chunks(batches, 1):
            owner, anchor, _, _, n = segments(hashes(list(chain.from_iterable(texts))), np.array([len(t) for t in texts]), length)
            order = np.lexsort((anchor, owner))
            owner, anchor = owner[order], anchor[order]
            new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(anchor, prepend=0) != 0))
            n = np.add.reduceat(n[order], new) if len(new) else new
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[new])), pa.array(anchor[new]), pa.array(n)], ["node", "anchor", "n"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches, 2):
            sizes, left = [len(t) for t in texts], []
            for words, spans in zip(texts, batch.column(3).to_pylist(), strict=True):
                if spans:
                    gone = np.zeros(len(words), bool)
                    for span in spans:
                        gone[span["begin"] : span["end"]] = True
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                left.append(words)
            removed = [n - len(w) for n, w in zip(sizes, left, strict=True)]
            kept = pa.array([b" ".join(w) for w in left], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept"])

    text = text_of().cast("binary")
    texts = docs.select("doc_id", _node(text).alias("node"), text.alias("text"))
    folder = f"{shared_folder(spark)}/anchors-{uuid.uuid4().hex}"
    texts.select("node", "text").mapInArrow(anchors, "node binary, anchor long, n long").write.parquet(folder)
    occurrences = spark.read.parquet(folder)
    shards = max(partitions(spark), -(-occurrences.count() // SHARD_ANCHORS))
    often = occurrences.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / HOT_ANCHOR).cast("long").alias("blocks"))
    marks = occurrences.select("node", "anchor").join(often, "anchor").groupBy("node").agg(F.collect_set(F.struct("anchor", "blocks")).alias("marks"), F.count("*").alias("n"))
    marks = marks.select("node", "marks", F.expr("n div size(marks)").alias("copies"))  # each copy has the same anchors

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(length, shards)
        for batch, words in _chunks(batches, 2):
            yield cutter.cut(batch, words)

    # Both joins keep all texts and all their columns, so that Spark deals the texts out once for both. What
    # a task sends hangs on the order of its texts, so a repeated task needs the same order.
    marked = texts.join(marks, "node", "left").select("doc_id", "node", "text", "marks", "copies").sortWithinPartitions("node")
    pieces = marked.mapInArrow(cut_out, PIECES)
    intervals = pieces.groupBy("shard").applyInPandas(lambda rows: _search_shard(rows, length), "node binary, begin long, end long")
    spans = intervals.groupBy("node").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return texts.join(spans, "node", "left").select("doc_id", "node", "text", "spans").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")
