"""Exact token counts of every prefix of every text, by dynamic programming.

In byte-pair encoding the encoding of a prefix that ends with token t is the encoding of the prefix
before t, plus t; and t is the one token ending there that its predecessor tolerates, that is, whose
bytes joined to the predecessor's encode as just these two. So the count at each place follows from
the count at an earlier place. White space in front of a run of other characters starts a new unit
whose encoding does not hang on what comes before, so the table is made once per distinct unit. New
pre-tokens are taken in order, so that each goes on from the states of the beginning that it has in
common with the one before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm.common import text_of

#: Units that a worker remembers; beyond that it forgets those not in use just now.
CACHED_UNITS = 400_000
#: So many characters of text are looked at together.
CHUNK_CHARS = 4_000_000
CACHED_PAIRS = 1_000_000
#: White space as the library's patterns see it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PrefixCounts:
    """Prefix tables for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(plain)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.longest = max(map(len, self.ids))
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.encode = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})._encode_single_piece
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.units = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.blank = re.compile(f"[{SPACE}]*").match
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, bytes] = {}
        self.tolerated: dict[tuple[int, int], bool] = {}

    def _tolerates(self, before: int, token: int) -> bool:
        pair = (before, token)
        found = self.tolerated.get(pair)
        if found is None:
            if len(self.tolerated) >= CACHED_PAIRS:
                self.tolerated.clear()
            found = self.tolerated[pair] = self.encode(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return found

    def of_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """For each pre-token what each of its characters adds to the count, a signed byte each."""
        get, tolerated, longest = self.ids.get, self.tolerated.get, self.longest
        out = {}
        before, last, count, steps = b"", [0], [0], bytearray()
        for piece in sorted(pieces):  # the order of code points is that of their bytes
            raw = piece.encode()
            same, most = 0, min(len(before), len(raw))
            while same < most and before[same] == raw[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :], steps[same:]
            for end in range(same + 1, len(raw) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = get(raw[start:end])
                    if token is not None:
                        if start:
                            good = tolerated((last[start], token))
                            if good is None:
                                good = self._tolerates(last[start], token)
                            if not good:
                                continue
                        n = count[start] + 1
                        steps.append((n - count[-1]) & 255)
                        last.append(token)
                        count.append(n)
                        break
            before = raw
            if len(raw) == len(piece):
                out[piece] = bytes(steps)
            else:  # only counts at ends of characters, which no continuation byte follows
                ends = [c for c, after in zip(count[1:], [*raw[1:], 0], strict=True) if after & 0xC0 != 0x80]
                out[piece] = bytes([(y - x) & 255 for x, y in zip([0, *ends[:-1]], ends, strict=True)])
        return out

    def _learn(self, units: list[str]) -> None:
        """Puts the table of each unit into ``known``."""
        split = [self.pieces(u) for u in units]
        wanted = set().union(*split)
        blanks = [self.blank(u).end() if len(p) > 1 else 0 for u, p in zip(units, split, strict=True)]
        wanted.update(u[:n] for u, n in zip(units, blanks, strict=True) if n > 1)
        wanted.update([p[1:] for p in wanted if p[0] == "'" and len(p) > 1 and p[1].isalpha()])
        steps = self.of_pieces(wanted)
        for unit, pieces, blank in zip(units, split, blanks, strict=True):
            found = b"".join([self._whole_ending(p, steps) if p[0] == "'" else steps[p] for p in pieces])
            if blank > 1:
                # A prefix that ends in white space has the whole run as one pre-token.
                total = sum(x - (x > 127) * 256 for x in found[: blank + 1])
                head = steps[unit[:blank]]
                found = head + bytes([(total - sum(x - (x > 127) * 256 for x in head)) & 255]) + found[blank + 1 :]
            self.known[unit] = found

    @staticmethod
    def _whole_ending(piece: str, steps: dict[str, bytes]) -> bytes:
        """The table of a pre-token such as 've: while it is not complete, its apostrophe stands alone."""
        if len(piece) == 1 or not piece[1].isalpha():
            return steps[piece]
        signed = lambda table: [x - (x > 127) * 256 for x in table]
        head = [1, *signed(steps[piece[1:]])[:-1]]
        return bytes([x & 255 for x in (*head, sum(signed(steps[piece])) - sum(head))])

    def steps(self, texts: list[str]) -> list[bytes]:
        """What each character of each text adds to the count; special strings count one at their end."""
        odd = [i for i, t in enumerate(texts) if self.special is not None and self.special.search(t)]
        out = self._plain([t if not odd or i not in set(odd) else "" for i, t in enumerate(texts)])
        for i in odd:
            out[i] = self._with_special(texts[i])
        return out

    def _with_special(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.special.finditer(text):
            before, upto = (np.frombuffer(s, "i1") for s in self._plain([text[at : m.start()], text[at : m.end()]]))
            head = upto[:-1]
            last = int(before.sum(dtype="i8")) + 1 - int(head.sum(dtype="i8"))
            out += [head.tobytes(), np.array([last], "i1").tobytes()]
            at = m.end()
        return b"".join([*out, *self._plain([text[at:]])])

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [self.units(t) for t in texts]
        used = set().union(*split)
        if len(self.known) > CACHED_UNITS:
            self.known = {u: self.known[u] for u in used & self.known.keys()}
        if new := list(used - self.known.keys()):
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, units)) for units in split]


_tables: dict[str, PrefixCounts] = {}


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, and ``steps``: the table of all prefixes of each text.

    ``steps`` holds a signed byte per code point: what that code point adds to the token count of the
    prefix that ends with it. Sums of it are exact counts for the byte-level BPE file ``tokenizer``, as the
    tokenizers library gives them for the prefix, special strings taken as it does by default. A null
    or empty text has 0 tokens and an empty table; repeated rows and null ids are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tables:
            _tables[tokenizer] = PrefixCounts(tokenizer)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, n = [], 0
                while at + len(texts) < whole.num_rows and n < CHUNK_CHARS:
                    texts.append(whole.column(2)[at + len(texts)].as_py())
                    n += len(texts[-1])
                batch = whole.slice(at, len(texts))
                at += len(texts)
                steps = _tables[tokenizer].steps(texts)
                counts = [int(np.frombuffer(s, "i1").sum(dtype="i8")) for s in steps]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(steps, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "steps"])

    text = text_of()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, steps binary")


@F.pandas_udf(T.LongType())
def tokens_of_prefix(steps: pd.Series, n_chars: pd.Series) -> pd.Series:
    """Tokens of the first ``n_chars`` code points."""
    return pd.Series([None if s is None or n is None else int(np.frombuffer(s, "i1")[: int(n)].sum(dtype="i8")) for s, n in zip(steps, n_chars, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def longest_prefix(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    def one(s, most):
        fits = np.flatnonzero(np.cumsum(np.frombuffer(s, "i1"), dtype="i8") <= most)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([None if s is None or b is None else one(s, b) for s, b in zip(steps, budget, strict=True)], dtype="Int64")


def truncated(text: Column, steps: Column, budget: int) -> Column:
    """The longest prefix of ``text`` that has at most ``budget`` tokens, without encoding again."""
    return F.substring(text, F.lit(1), longest_prefix(steps, F.lit(budget)).cast("int"))
