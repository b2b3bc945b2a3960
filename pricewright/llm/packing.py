"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

Every task keeps a fixed number of open windows. A document's rest (what is left after its full
windows) goes to the window where it leaves the least room. When it fits into none, the fullest window
is filled with the rest's beginning and emitted. At the end a task pours its open windows into one
another, which leaves one partial window; these are merged in groups of tasks by a second step.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.common import cut, text_of

#: Partial windows of so many tasks are merged by one task of the second step.
MERGE_TASKS = 128
#: Words that a worker remembers with their ids; beyond that it forgets those not in use just now.
CACHED_WORDS = 400_000
#: So many characters of text are looked at together.
CHUNK_CHARS = 2_000_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECE_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


class WordTokens:
    """Ids of texts for a word-end BPE file, word by word.

    White space only separates in such a file, so the ids of a text are those of its words in turn.
    Words seen for the first time are merged by tiktoken over the file's own vocabulary, where byte
    1 stands for the end of a word. That is done for words of characters on which Unicode's versions
    agree; other words go to the tokenizers library one by one, and texts with control characters, special
    strings or capital sigma, whose lower case hangs on its place, go there whole.
    """

    ODD = re.compile("[\x00-\x08\x0e-\x1fΣ]|<\\|")
    #: Blocks in which every code point was held against the library.
    UNSURE = re.compile("[^\x02!-\u02ff\u0400-\u052f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u22ff\u3001-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|\x02|[^\s\x02\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.split = regex.compile(self.PIECES).findall
        chars = self._byte_chars(pre_tokenizers)
        ranks = {}
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            word_end = token.endswith("</w>")
            body = bytes(chars[c] for c in (token[:-4] if word_end else token) if c in chars)
            if i < 49406:
                ranks[body + b"\x01" * word_end] = i
        self.merge = tiktoken.Encoding("words", pat_str="[^\x01\x02]*\x01|\x02", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.stop = ranks[b"\x02"]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _byte_chars(pre_tokenizers) -> dict[str, int]:
        """The byte that each character of a byte-level vocabulary stands for."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(plain)]
        out = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        assert set(out) == set(pre_tokenizers.ByteLevel.alphabet())
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        if self.UNSURE.search("".join(words)):
            unsure = set(filter(self.UNSURE.search, words))
            self.known.update((w, self._whole(w)) for w in unsure)
            words = [w for w in words if w not in unsure]
        # All words at once, each closed by byte 2, which no word holds.
        pieces = self.split(unicodedata.normalize("NFC", "".join(w + "\x02" for w in words)).lower())
        ids = self.merge("".join(p + "\x01" for p in pieces).replace("\x02\x01", "\x02"), disallowed_special=()).astype("<u4")
        ends = np.flatnonzero(ids == self.stop)
        raw, at = ids.tobytes(), 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.known[w] = raw[at : 4 * end]
            at = 4 * end + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [None if self.ODD.search(t) else t.split() for t in texts]
        used = set().union(*filter(None, split))
        if len(self.known) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in used & self.known.keys()}
        if new := list(used - self.known.keys()):
            self._learn(new)
        get = self.known.__getitem__
        return [self._whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]


class Packer:
    """Open windows of one task. Pieces are (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, size: int, open_windows: int, least_cut: int, first_id: int):
        self.size, self.most, self.least_cut, self.next_id = size, open_windows, least_cut, first_id
        self.room: list[int] = []  # ascending room of the open windows, and their pieces
        self.open: list[list[tuple]] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], keep: bool = False) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if keep else None))
            offset += n
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, total: int, ids: bytes) -> None:
        while len(ids) >= 4 * self.size:
            self.emit([(doc_id, start, total, ids[: 4 * self.size])])
            start, ids = start + self.size, ids[4 * self.size :]
        while ids:
            n = len(ids) // 4
            i = bisect.bisect_left(self.room, n)
            if i < len(self.room):
                room, pieces = self.room.pop(i), self.open.pop(i)
                pieces.append((doc_id, start, total, ids))
                self._put(room - n, pieces)
                return
            if len(self.room) < self.most:
                self._put(self.size - n, [(doc_id, start, total, ids)])
                return
            room, pieces = self.room.pop(0), self.open.pop(0)
            if room >= self.least_cut:
                pieces.append((doc_id, start, total, ids[: 4 * room]))
                start, ids = start + room, ids[4 * room :]
            self.emit(pieces)

    def _put(self, room: int, pieces: list[tuple]) -> None:
        if not room:
            return self.emit(pieces)
        i = bisect.bisect_left(self.room, room)
        self.room.insert(i, room)
        self.open.insert(i, pieces)

    def pour(self) -> list[tuple]:
        """Fills the fullest open windows with the pieces of the emptiest; returns what the last one holds."""
        loose = [p for pieces in self.open for p in pieces]
        self.room, self.open, self.most = [], [], 0
        window, room = [], self.size
        for doc_id, start, total, ids in loose:
            while ids:
                part = ids[: 4 * room]
                window.append((doc_id, start, total, part))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                if not room:
                    self.emit(window)
                    window, room = [], self.size
        return window


_encoders: dict[str, WordTokens] = {}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts, n = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            n += len(texts[-1])
            if n >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, n = [], [], 0
        if ids:
            yield ids, texts


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE_ARROW, strict=True)], schema=PIECE_ARROW)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, open_windows: int = 64, least_cut: int = 16) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``size`` ids.

    A document is its ids under the word-end BPE file ``tokenizer`` and then ``end_id``. One row per
    piece: doc_id, start, length, ids_crc32 (of the little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset (gapless from 0). A null or empty text is the end id alone; repeated rows are
    documents of their own; a null doc_id stays null; an empty table gives an empty result. Every id
    lies in exactly one piece. A window is emitted with up to ``least_cut`` - 1 places left, or full;
    beyond that only one window per ``MERGE_TASKS`` tasks is partial. A task's result hangs on its
    input split alone, so a repeated task repeats its result.
    """

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordTokens(tokenizer)
        encode, end = _encoders[tokenizer].encode, np.array([end_id], "<u4").tobytes()
        packer = Packer(size, open_windows, least_cut, TaskContext.get().partitionId() << 32)
        for doc_ids, texts in _chunks(batches):
            for doc_id, ids in zip(doc_ids, encode(texts), strict=True):
                packer.add(doc_id, 0, len(ids) // 4 + 1, ids + end)
            if packer.rows:
                yield _as_batch(packer.rows)
                packer.rows = []
        if rest := packer.pour():
            packer.emit(rest, keep=True)
        if packer.rows:
            yield _as_batch(packer.rows)

    def merge_group(rows):
        import pandas as pd

        packer = Packer(size, 0, 0, (1 << 62) | (int(rows["sequence_id"].iloc[0]) // (MERGE_TASKS << 32)) << 32)
        rows = rows.sort_values(["sequence_id", "offset"])
        # Missing ids of documents would turn the column into floats; they come as nullable integers.
        packer.open = [[(None if pd.isna(d) else int(d), int(s), int(t), bytes(i)) for d, s, t, i in zip(rows["doc_id"].astype("Int64"), rows["start"], rows["doc_tokens"], rows["ids"], strict=True)]]
        if rest := packer.pour():
            packer.emit(rest)
        out = pd.DataFrame(packer.rows, columns=PIECE_ARROW.names)
        return out.astype({"doc_id": "Int64"})

    first = cut(docs.select("doc_id", text_of().alias("text")).mapInArrow(pack_task, PIECE_SCHEMA))
    done = first.where("ids is null")
    group = F.expr(f"sequence_id div {MERGE_TASKS << 32}")
    merged = first.where("ids is not null").groupBy(group.alias("tasks")).applyInPandas(merge_group, PIECE_SCHEMA)
    return done.unionByName(merged).drop("ids")
