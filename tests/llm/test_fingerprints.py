import hashlib
import unicodedata

from pricewright.llm import fingerprints


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", t or "").casefold()).split())


ROWS = [(5, "Straße  und\tmehr"), (1, "strasse und MEHR "), (9, None), (3, ""), (3, ""), (3, "Ａｂｃ é"), (None, "abc é"), (7, "ab" * 5000), (12, "x")]


def test_edited_likeness(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, k string")
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == len(ROWS)
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, []).append(r.doc_id)
    # The two spellings share one fingerprint, the three empty texts another, the two accents a third.
    assert sorted(map(len, prints.values())) == [1, 1, 2, 2, 3]
    by_id = {r.doc_id: r for r in got if r.doc_id in (5, 7, 12)}
    edited = ROWS[0][1][:8] + ("ab" * 5000)[:8]
    assert by_id[5].n_chars == 16 and by_id[5].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert by_id[5].near_edited == 0.0
    # The last document is followed by the first, and one code point has no half to replace.
    assert by_id[12].edited_sha256 == hashlib.sha256(b"x").hexdigest() and by_id[12].near_edited == 1.0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.edited_likeness(docs).count() == 0


def test_canonical_like_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in docs.select("text", fingerprints.canonical(docs.text).alias("c")).collect():
        assert r.c == canon(r.text)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {}
    for i, (doc_id, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - half] + after[:half]
        want[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canon(text) == canon(edited)), float(canon(text) == canon(after)), canon(text))
    got = fingerprints.edited_likeness(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == {k: v[:4] for k, v in want.items()}
    assert len({r.fingerprint for r in got}) == len({v[4] for v in want.values()})
