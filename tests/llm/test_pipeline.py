import corpus_pipeline
import test_near_dup
import test_packing


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "123 %%", None, None, 6), (10**6 + 1, None, "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(odd)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {10**6, 10**6 + 1}
    before, after = seen["near_duplicates"]
    classes = test_near_dup.brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in classes})
    before, after = seen["pii"]
    changed = [(b.text, a.text) for b, a in zip(sorted(before), sorted(after), strict=True) if b.text != a.text]
    assert changed and all("@" in b or any(c.isdigit() for c in b) for b, _ in changed) and len(before) == len(after)
    before, after = seen["mixing"]
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text in texts[r.doc_id] for r in after)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) <= 40
    before, after = seen["packing"]
    assert test_packing.check(after, [(r.doc_id, r.text) for r in before], 2048)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def kept_and_lettered(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").select("doc_id").collect()}
    return kept, {r.doc_id for r in docs.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or "")}


def test_language_stage_keeps_clean_documents_beyond_the_sample(spark):
    """A language with several times the rows that the network is fitted on loses no document."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert max(r["count"] for r in docs.groupBy("lang").count().collect()) > 5000
    kept, lettered = kept_and_lettered(spark, docs)
    assert kept == lettered


def test_language_stage_rejects_by_score(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    least = corpus_pipeline.LEAST_TIMES_EVEN
    monkeypatch.setattr(corpus_pipeline, "LEAST_TIMES_EVEN", 3.95)  # 0.9875 of four languages
    kept, lettered = kept_and_lettered(spark, docs)
    assert len(lettered) - 12 <= len(kept) < len(lettered)
    monkeypatch.setattr(corpus_pipeline, "LEAST_TIMES_EVEN", 4.01)
    assert not kept_and_lettered(spark, docs)[0] and 1 < least < 1.5


def test_language_stage_without_labels(spark):
    rows = [(1, "some words", None, "src1", 10), (2, "123 %%", None, "src1", 6), (3, None, None, "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()] == [1]


def test_stages_keep_clashing_columns(spark, sf_dir):
    names = ["score", "lang_pred", "_text", "row", "_said", "n_replaced", "_found", "_new", "_mine", "_number", "n_words", "bucket"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("*", *(docs.doc_id.alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        rows = docs.collect()
        assert rows and all(r[n] == r.doc_id for r in rows for n in names)
