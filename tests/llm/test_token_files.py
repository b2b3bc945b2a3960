import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricewright.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_words(ids):
    """One word after the other: the selector of the largest count whose next ids fit and are there."""
    out, escapes = [], 0
    for block in range(0, len(ids), token_files.BLOCK):
        here, at = ids[block : block + token_files.BLOCK], 0
        while at < len(here):
            for selector, (width, count) in enumerate(zip(token_files.WIDTHS.tolist(), token_files.COUNTS.tolist(), strict=True)):
                run = here[at : at + count]
                if len(run) == count and all(x < 2**width for x in run):
                    out.append(selector << 60 | sum(x << (width * i) for i, x in enumerate(run)))
                    at += count
                    break
            else:
                out.append(token_files.ESCAPE << 60 | escapes)
                escapes, at = escapes + 1, at + 1
    return out


NUMBERS = st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1), st.sampled_from([2**60 - 1, 2**60]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(NUMBERS, st.integers(1, 70)), max_size=25))
def test_words(runs):
    ids = [x for x, n in runs for _ in range(n)]
    words, offsets, escapes = token_files.encode(np.array(ids, "u8"))
    assert words.tolist() == plain_words(ids)
    assert token_files.decode(words, escapes).tolist() == ids
    record = token_files.Record(token_files.Record.written([None, 5], [0, len(ids)], np.array(ids, "u8")))
    assert record.ids().tolist() == ids and (record.n_docs, record.n_null) == (2, 1)
    for first, last in [(0, 1), (127, 129), (len(ids) // 2, len(ids)), (len(ids), len(ids) + 9)]:
        assert record.ids(first, last).tolist() == ids[first:last]
    assert len(offsets) == -(-len(ids) // token_files.BLOCK)


def test_files(spark, tmp_path, monkeypatch):
    """Whole round trip against the library, over several records and files a task."""
    monkeypatch.setattr(token_files, "RECORD_IDS", 50)
    monkeypatch.setattr(token_files, "RECORDS_PER_FILE", 2)
    r, library = random.Random(4), Tokenizer.from_file(PATH)
    texts = ["", None, "é日😀 Σ <|endoftext|>", "  ", "word " * 3000] + [" ".join(r.choice(["a", "tree", "12", "!?", "lorem"]) for _ in range(r.randrange(40))) for _ in range(150)]
    rows = [(i * 7 % 155 - 20, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, "twice"), (3, "twice"), (2**62, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS hash", "1 AS UID")
    token_files.write_ids(df.repartition(5), PATH, f"{tmp_path}/ids")
    got = sorted(token_files.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda x: x.start)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    key = lambda d, raw: (d is not None, d or 0, raw)
    assert sorted(key(x.doc_id, bytes(x.ids)) for x in got) == sorted(key(d, ids(t)) for d, t in rows)
    assert [x.doc_id for x in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for x in got:
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(x.ids) // 4, zlib.crc32(bytes(x.ids)))
        start += x.n_tokens
    assert len(list((tmp_path / "ids").glob("part-*"))) > 10
    raw = next((tmp_path / "ids").glob("part-*")).read_bytes()
    assert len(raw) % 8 == 0
    with pytest.raises(ValueError):
        next(token_files.records(raw[8:]))


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_ids(df, PATH, f"{tmp_path}/none")
    assert token_files.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_whole_table(spark, sf_dir):
    library, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in queries.op11_token_files(spark, sf_dir).collect()}
    rows = sorted(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
