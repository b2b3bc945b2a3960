"""Vector codes: each part of a vector becomes the number of the nearest entry of its part's codebook.

Tasks sort the parts of a bounded shard of vectors along a Hilbert curve and cut them into flat blocks, once. A
block holds the min/max box of its points and their sum. In a round a block's box gives, by its least and
greatest distance to each entry, a short list of entries that can be nearest to any point in it. A list of
one settles the block by its sum alone; else a small integer kernel compares the points with the listed entries.
Tasks send sums per entry only, and the codebooks, as bounded as a vector is long, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.common import cut
from pricewright.llm.topk import integer_vector

PARTS, ENTRIES = 16, 64
#: The most points and components of a block (batches hold many), and the most vectors and bytes of a shard.
BLOCK, BLOCK_COMPONENTS, SHARD_ROWS, SHARD_BYTES = 32, 1024, 32_768, 32_000_000
#: Components under this make squared distances of vectors of 16 parts of up to 512 components exact in 64 bits.
SMALL = 2**23
LARGEST = 2**63 - 1

BLOCK_SCHEMA = "shard long, part int, n int, place binary, points binary, low array<long>, high array<long>, total array<decimal(38,0)>, vec_id array<long>, label array<long>"
BLOCK_ARROW = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("place", pa.binary()), ("points", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("total", pa.list_(pa.decimal128(38, 0))), ("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64()))])


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The order of the points along a Hilbert curve through the eight components that spread most.

    Components are scaled to the points' own box; the order decides how tight the blocks are, and no result.
    """
    n, width = points.shape
    if not n or not width:
        return np.arange(n)
    floats = points.astype("f8")
    low, high = floats.min(0), floats.max(0)
    axes = np.sort(np.argsort(low - high, kind="stable")[:8])
    bits = min(16, 62 // len(axes))
    spread = np.where(high[axes] > low[axes], high[axes] - low[axes], 1.0)
    x = ((floats[:, axes] - low[axes]) / spread * (2**bits - 1)).astype("i8").T.copy()
    # From coordinates to the transposed index: undo the rotations from the highest bit down, then Gray-code.
    bit = 1 << (bits - 1)
    while bit > 1:
        mask = bit - 1
        for i in range(len(axes)):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(on, mask, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(axes)):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, "i8")
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(n, "i8")
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return np.argsort(key, kind="stable")


def _shard_blocks(shard: int, ids: list, labels: list, vectors: np.ndarray) -> pa.RecordBatch:
    """The blocks of one shard, headed by a row (part -1) with its ids and labels."""
    rows = [(shard, -1, len(ids), None, None, None, None, None, ids, labels)]
    for part, points in enumerate(np.split(vectors, PARTS, axis=1)):
        order = hilbert_order(points)
        size = max(1, min(BLOCK, BLOCK_COMPONENTS // max(points.shape[1], 1)))
        for at in range(0, len(order), size):
            place = order[at : at + size]
            here = points[place]
            total = here.astype(object).sum(0) if len(here) and np.abs(here.astype("f8")).max(initial=0) >= 2**53 else here.sum(0)
            rows.append((shard, part, len(place), place.astype("<u4").tobytes(), here.astype("<i8").tobytes(), here.min(0).tolist(), here.max(0).tolist(), [int(x) for x in total], None, None))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    """Blocks of all rows (vec_id, label, vector); vectors end in zeros up to ``length``."""
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(length, 1))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, labels, vectors = TaskContext.get().partitionId() << 32, [], [], np.zeros((most, length), "i8")
        for batch in batches:
            arrays = batch.column(2)
            ends, flat = arrays.offsets.to_numpy(), arrays.values.to_numpy(zero_copy_only=False)
            for k, (vec_id, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                vectors[len(ids)] = 0
                vectors[len(ids), : ends[k + 1] - ends[k]] = flat[ends[k] : ends[k + 1]]
                ids.append(vec_id)
                labels.append(label)
                if len(ids) == most:
                    yield _shard_blocks(shard, ids, labels, vectors)
                    shard, ids, labels = shard + 1, [], []
        if ids:
            yield _shard_blocks(shard, ids, labels, vectors[: len(ids)])

    return rows.select("vec_id", F.col("label").cast("long").alias("label"), "vector").mapInArrow(build, BLOCK_SCHEMA)


def _box_distances(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest squared distance of each entry to the points of a box."""
    below, above = low - entries, entries - high
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return (near * near).sum(1), (far * far).sum(1)


def short_list(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries, ascending, that can be the nearest to a point in the box, ties included."""
    near, far = _box_distances(low, high, entries)
    return np.flatnonzero(near <= far.min())


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries for each point, and the squared distance."""
    apart = points[:, None, :] - entries[None]
    distance = (apart * apart).sum(2)
    best = distance.argmin(1)
    return best, distance[np.arange(len(points)), best]


class Codebooks:
    """Integer codebooks, one of ``entries`` x width numbers for each part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # parts x entries x width
        self.large = entries.astype(object)
        self.small = bool(entries.size == 0 or np.abs(entries.astype("f8")).max() < SMALL) and entries.shape[2] <= 512

    def fits(self, low: list[int], high: list[int]) -> bool:
        return self.small and min(low, default=0) > -SMALL and max(high, default=0) < SMALL

    def listed(self, part: int, low: list[int], high: list[int]) -> tuple[np.ndarray, np.ndarray, str | type]:
        """The short list, its entries, and the type of numbers in which the block's distances are exact."""
        kind = "i8" if self.fits(low, high) else object
        entries = self.entries[part] if kind == "i8" else self.large[part]
        chosen = short_list(np.array(low, kind), np.array(high, kind), entries)
        return chosen, entries[chosen], kind

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.reshape(-1)).encode()).hexdigest()


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _moved(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after a round: each entry the rounded-down mean of its points; unused ones stay."""
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), "i8")
        for batch in batches:
            for part, n, points, low, high, total in _columns(batch):
                chosen, listed, kind = books.listed(part, low, high)
                if len(chosen) == 1:
                    sums[part, chosen[0]] += np.array([int(x) for x in total], object)
                    counts[part, chosen[0]] += n
                    continue
                here = np.frombuffer(points, "<i8").reshape(n, width)
                best, _ = nearest(here.astype(kind), listed)
                for k in np.unique(best):
                    mine = here[best == k]
                    sums[part, chosen[k]] += (mine if kind == "i8" else mine.astype(object)).sum(0).astype(object)
                    counts[part, chosen[k]] += len(mine)
        rows = [(int(p), int(e), int(counts[p, e]), [int(x) for x in sums[p, e]]) for p, e in np.argwhere(counts)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))), strict=True)], ["part", "entry", "n", "sums"])

    points = blocks.where("part >= 0").select("part", "n", "points", "low", "high", "total")
    partial = points.mapInArrow(add, "part int, entry int, n long, sums array<decimal(38,0)>")
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))).collect()
    moved = books.entries.copy()
    for row in found:
        moved[row.part, row.entry] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return Codebooks(moved)


def _coded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every row; the blocks of a shard lie in one task."""
    width = books.entries.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, labels, codes, errors = None, [], [], None, None

        def rows() -> pa.RecordBatch:
            text = np.ascontiguousarray(codes).tobytes().hex()
            each = [text[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(ids))]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(each), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

        for batch in batches:
            for name, part, n, place, points, low, high, own_ids, own_labels in _columns(batch):
                if part < 0:
                    if shard is not None:
                        yield rows()
                    shard, ids, labels, codes, errors = name, own_ids, own_labels, np.zeros((n, PARTS), "u1"), np.zeros(n, "i8")
                    continue
                chosen, listed, kind = books.listed(part, low, high)
                best, distance = nearest(np.frombuffer(points, "<i8").reshape(n, width).astype(kind), listed)
                at = np.frombuffer(place, "<u4")
                codes[at, part] = chosen[best]
                if kind is object and errors.dtype != object:
                    errors = errors.astype(object)
                errors[at] += distance
        if shard is not None:
            yield rows()

    columns = blocks.select("shard", "part", "n", "place", "points", "low", "high", "vec_id", "label")
    return columns.mapInArrow(assign, "vec_id long, label long, code string, error long")


def codes(embeddings: DataFrame, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a whole vector.

    Vectors that are null or hold null or non-finite components go. Components become floor(256 * x), beyond a
    long the greatest or least one. A vector that is shorter than the longest, or whose length isn't a multiple of
    16, counts as ending in zeros up to the next one. The first codebooks are the parts of the 64 smallest ids (null
    last, ties by vector; all, if there are fewer rows); entries may be equal, and the first then has their points.
    Ties go to the lower index. Repeated rows and null ids keep rows of their own; errors are exact, and an error or
    sum beyond a long is the greatest one. An empty table gives no rows. Other columns don't matter.
    """
    rows = embeddings.select("vec_id", "label", integer_vector(F.col("embedding")).alias("vector")).where("vector is not null")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    length = -(-longest // PARTS) * PARTS
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    first = np.array([r.vector + [0] * (length - len(r.vector)) for r in head], "i8").reshape(len(head), PARTS, length // PARTS)
    books = Codebooks(first.transpose(1, 0, 2).copy())
    blocks = cut(_blocks(rows, length))
    for _ in range(rounds):
        books = _moved(blocks, books)
    coded = cut(_coded(blocks, books))
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
