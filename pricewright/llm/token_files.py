"""Token-id files: word-aligned coding of ids in 64-bit words, written and read back by Spark.

The four highest bits of a word are its selector, which says how many ids of how many bits the other 60
hold: 60 of one bit, 30 of two, and so on to one of 60. Larger ids are escapes: their word holds a place in a
list of whole ids behind the words. Ids are cut into blocks of 128; the offset of each block's first word is
stored, so that a stretch of ids is decoded without what lies before it. Encoder and decoder work on all blocks
or words of one selector at a time.

A file is a row of records, each a header, the documents, the block offsets, the words and the escapes, in
little-endian 64-bit units, and an end mark. Spark's own writer writes them, so that they land wherever Spark can write,
and a task that is lost and repeated leaves one copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.common import text_of
from pricewright.llm.packing import CACHED_WORDS, WordTokens, _chunks

WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // WIDTHS
ESCAPE = len(WIDTHS)
#: Ids of a block, and the most ids of a record but for one long document.
BLOCK, RECORD_IDS = 128, 1 << 18
RECORDS_PER_FILE = 64
MAGIC, END = b"S8BIDS01", b"S8B-END\n"
PAYLOAD = np.uint64(2**60 - 1)
#: The greatest number of each width, and the least selector of every number of 16 bits.
LIMITS = 2 ** WIDTHS.astype("u8") - np.uint64(1)
FIT_SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype="u8")).astype("i1")


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of unsigned 64-bit ``ids``, the offset of each block's first word, and the escapes."""
    ids = np.ascontiguousarray(ids, "<u8")
    blocks = -(-len(ids) // BLOCK)
    # The least selector that fits each id, a column for each block; beyond the end nothing fits.
    fit = np.full(blocks * BLOCK, ESCAPE + 1, "i1")
    small = ids < len(FIT_SMALL)
    fit[: len(ids)] = FIT_SMALL[np.where(small, ids, 0).astype("u4")]
    fit[: len(ids)][~small] = np.searchsorted(LIMITS, ids[~small])
    fit = np.ascontiguousarray(fit.reshape(blocks, BLOCK).T)
    place = np.arange(BLOCK, dtype="u1")[:, None]
    chosen = np.full((BLOCK, blocks), ESCAPE, "i1")
    for selector in range(ESCAPE - 1, -1, -1):
        # Where the run of ids that fit breaks off. A larger count fits only where all smaller ones do, so each takes one off.
        reach = np.maximum((fit <= selector).view("u1") * np.uint8(BLOCK), place)
        for i in range(BLOCK - 2, -1, -1):
            np.minimum(reach[i], reach[i + 1], out=reach[i])
        reach -= place
        chosen -= reach >= COUNTS[selector]
    count_of = np.append(COUNTS, 1)
    at, open_blocks, lengths = np.zeros(blocks, "i8"), np.arange(blocks), np.count_nonzero(fit <= ESCAPE, axis=0)
    steps = []
    while len(open_blocks):
        selectors = chosen[at[open_blocks], open_blocks]
        steps.append((open_blocks, open_blocks * BLOCK + at[open_blocks], selectors))
        at[open_blocks] += count_of[selectors]
        open_blocks = open_blocks[at[open_blocks] < lengths[open_blocks]]
    if not steps:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4"), np.zeros(0, "<u8")
    block, first, selectors = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(block, kind="stable")
    first, selectors = first[order], selectors[order]
    offsets = np.searchsorted(block[order], np.arange(blocks)).astype("<u4")
    words = selectors.astype("u8") << np.uint64(60)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            words[mine] |= np.arange(len(mine), dtype="u8")
        else:
            slots = np.arange(COUNTS[selector])
            shifted = ids[first[mine][:, None] + slots] << (slots * WIDTHS[selector]).astype("u8")
            words[mine] |= np.bitwise_or.reduce(shifted, axis=1)
    return words.astype("<u8"), offsets, ids[first[selectors == ESCAPE]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of consecutive words."""
    selectors = (words >> np.uint64(60)).astype("i1")
    counts = np.append(COUNTS, 1)[selectors]
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), "<u8")
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[first[mine]] = escapes[words[mine] & PAYLOAD]
        else:
            slots = np.arange(COUNTS[selector])
            parts = (words[mine][:, None] >> (slots * WIDTHS[selector]).astype("u8")) & np.uint64(2 ** int(WIDTHS[selector]) - 1)
            out[first[mine][:, None] + slots] = parts
    return out


class Record:
    """One record of a file: ids of consecutive documents."""

    HEADER = 7

    def __init__(self, raw: bytes, start: int = 0):
        if raw[start : start + 8] != MAGIC:
            raise ValueError("not a record of token ids")
        units = np.frombuffer(raw, "<u8", self.HEADER, start)
        self.n_docs, self.n_null, self.n_ids, blocks, words, escapes = (int(x) for x in units[1:])
        at = start + 8 * self.HEADER
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.lengths = np.frombuffer(raw, "<i8", self.n_docs, at + 8 * self.n_docs)
        at += 16 * self.n_docs
        self.offsets = np.frombuffer(raw, "<u4", blocks, at)
        at += 8 * -(-blocks // 2)
        self.words = np.frombuffer(raw, "<u8", words, at)
        self.escapes = np.frombuffer(raw, "<u8", escapes, at + 8 * words)
        self.end = at + 8 * (words + escapes)

    @staticmethod
    def written(doc_ids: list[int | None], lengths: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
        """The bytes of a record; documents without an id come first."""
        words, offsets, escapes = encode(ids)
        header = np.array([len(doc_ids), sum(d is None for d in doc_ids), len(ids), len(offsets), len(words), len(escapes)], "<u8")
        names = np.array([0 if d is None else d for d in doc_ids], "<i8")
        padding = b"\0" * (4 * (len(offsets) % 2))
        return b"".join([MAGIC, header.tobytes(), names.tobytes(), np.array(lengths, "<i8").tobytes(), offsets.tobytes(), padding, words.tobytes(), escapes.tobytes()])

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from place ``first`` up to ``last``; only their blocks are decoded."""
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, "<u8")
        block, end = first // BLOCK, -(-last // BLOCK)
        stop = int(self.offsets[end]) if end < len(self.offsets) else len(self.words)
        found = decode(self.words[int(self.offsets[block]) : stop], self.escapes)
        return found[first - block * BLOCK : last - block * BLOCK]


def records(raw: bytes) -> Iterator[Record]:
    """The records of a file."""
    at = 0
    while at < len(raw):
        record = Record(raw, at)
        if raw[record.end : record.end + len(END)] != END:
            raise ValueError("a record without its end mark")
        at = record.end + len(END)
        yield record


class SplitWords(WordTokens):
    """The packer's encoder, asked for words instead of texts."""

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words, none if a word is empty, as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.known[""] = b""
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        return [self.known[w] for w in words]


_encoders: dict[str, SplitWords] = {}


def ids_of_texts(encoder: SplitWords, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, ``end_id`` after each, and how many each text has with it.

    Words are split and numbered by Arrow; each different word is looked up once, and the ids are then gathered.
    """
    whole = pa.array(texts, pa.string())
    odd = np.flatnonzero(pc.match_substring_regex(whole, encoder.ODD.pattern).to_numpy(zero_copy_only=False))
    if len(odd):
        whole = pa.array(["" if o else t for t, o in zip(texts, np.isin(np.arange(len(texts)), odd), strict=True)], pa.string())
    words = pc.utf8_split_whitespace(whole)
    numbered = words.flatten().dictionary_encode()
    parts = encoder.ids_of_words(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
    lengths = np.fromiter(map(len, parts), "i8", len(parts)) // 4
    ids, starts, number = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(lengths) - lengths, numbered.indices.to_numpy()
    each = lengths[number]
    ends = np.cumsum(each)
    ids = ids[np.repeat(starts[number] - ends + each, each) + np.arange(int(each.sum()))]
    bounds = np.append(0, ends)[words.offsets.to_numpy()]
    if len(odd):
        pieces = np.split(ids, bounds[1:-1])
        for i in odd:
            pieces[i] = np.frombuffer(encoder.encode([texts[i]])[0], "<u4")
        ids, bounds = np.concatenate(pieces), np.append(0, np.cumsum([len(p) for p in pieces]))
    return np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> None:
    """Writes the ids of all documents under a word-end BPE file, ``end_id`` after each, into a new ``folder``.

    Documents ascend by doc_id over the files in the order of their names (null first; equal ids by a hash of the text,
    repeated rows are documents of their own). A null or empty text is the end id alone. Rows are dealt
    by ranges, and a task holds a few million characters and their ids, or one longer document's. Other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = SplitWords(tokenizer)
        for names, texts in _chunks(batches):
            ids, lengths = ids_of_texts(_encoders[tokenizer], texts, end_id)
            ends = np.cumsum(lengths)
            first = 0
            while first < len(names):
                # Documents up to the one that completes a record, so that none is cut.
                begin = int(ends[first - 1]) if first else 0
                last = min(int(np.searchsorted(ends, begin + RECORD_IDS)) + 1, len(names))
                record = Record.written(names[first:last], lengths[first:last], ids[begin : ends[last - 1]])
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])
                first = last

    rows = docs.select("doc_id", text_of().alias("text")).withColumns({"hash": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "hash", "uid"]
    inorder = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # The text writer takes a string's bytes as they are; its line end is the record's end mark.
    coded = inorder.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    coded.write.options(lineSep=END.decode(), compression="none", maxRecordsPerFile=RECORDS_PER_FILE).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda i: F.regexp_extract("path", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", i).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(number(1).alias("part"), number(2).alias("piece"), "content")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files in ``folder``: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids.

    ``ids`` are unsigned 32-bit little-endian numbers, and left out without ``with_ids``; the checksum is theirs.
    A first pass adds the ids of each file up, one row for each; no row in the folder gives none here.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [sum(r.n_ids for r in records(raw.as_py())) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["part", "piece", "n"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                before = 0
                for r in records(raw.as_py()):
                    ends = np.cumsum(r.lengths)
                    starts = ends - r.lengths
                    ids = r.ids().astype("<u4").tobytes()
                    each = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    names = pa.array(r.doc_ids, pa.int64(), mask=np.arange(r.n_docs) < r.n_null)
                    columns = [pa.array([part] * r.n_docs, pa.int64()), pa.array([piece] * r.n_docs, pa.int64()), names, pa.array(starts + before), pa.array(r.lengths), pa.array([crc32(x) for x in each], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(each if with_ids else [None] * r.n_docs, pa.binary())], ["part", "piece", "doc_id", "first", "n_tokens", "ids_crc32", "ids"])
                    before += r.n_ids

    files = _files(spark, folder)
    sums = files.mapInArrow(totals, "part long, piece long, n long")
    before = sums.select(F.col("part").alias("of"), F.col("piece").alias("of_piece"), (F.sum("n").over(Window.orderBy("part", "piece")) - F.col("n")).alias("before"))
    found = files.mapInArrow(documents, "part long, piece long, doc_id long, first long, n_tokens long, ids_crc32 long, ids binary")
    out = found.join(before, (F.col("part") == F.col("of")) & (F.col("piece") == F.col("of_piece"))).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
