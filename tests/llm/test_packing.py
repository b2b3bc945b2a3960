import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pricewright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, size):
    library = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(pieces) == set(want)
    for doc_id, encodings in want.items():
        if len(encodings) > 1:
            assert sum(r.length for r in pieces[doc_id]) == sum(map(len, encodings))
            continue
        at, ids = 0, encodings[0]
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(sequences), sum(r.length for r in rows)


DOCS = [(1, None), (2, ""), (3, "It's <|endoftext|> ΑΣ Σας 12 3½"), (4, "lorem ipsum " * 3000), (5, "a"), (5, "a"), (None, "b c"), (7, "\x01 odd \x1c"), (8, "ﬁ é ß don't"), (9, "　 x")]


@pytest.mark.parametrize("size", [8, 2048])
def test_small(spark, size):
    df = spark.createDataFrame([(i, t, 7) for i, t in DOCS], "doc_id long, text string, offset int").repartition(3)
    check(packing.pack(df, PATH, size=size, open_windows=2, least_cut=2).collect(), DOCS, size)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_whole_table_has_little_padding(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n, total = check(packing.pack(df.repartition(5), PATH).collect(), [tuple(r) for r in df.collect()], 2048)
    assert n * 2048 - total <= 2048 + 16 * n


def test_ids_of_every_code_point_that_is_not_left_to_the_library():
    from tokenizers import Tokenizer

    words, library = packing.WordTokens(PATH), Tokenizer.from_file(PATH)
    sure = [c for c in range(33, 0x110000) if not 0xD800 <= c < 0xE000 and not words.UNSURE.search(chr(c))]
    some = [c for c in range(0x80, 0x40000, 29) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 7{chr(c)} {chr(c)}{chr(c)} x" for c in sure + some + [0x558, 0x58B, 0x88F, 0x1C89, 0xA7CB, 0x10940, 0x16EA0, 0x323B0]]
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, mine, his in zip(texts, words.encode(texts), want, strict=True) if list(memoryview(mine).cast("I")) != his.ids]
    assert len(sure) > 30_000 and wrong == []
