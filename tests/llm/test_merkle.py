import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from pricewright.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def plain_hash(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row):
    return plain_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([plain_hash(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_proof(levels, i, arity):
    out = []
    for level in levels[:-1]:
        run = level[i - i % arity :][:arity]
        out.append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
        i //= arity
    return out


def brute(rows, arity=2):
    """(id, leaf, subroot, root, proof, folded root) of each row, one after the other."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    groups = [sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for g in names]
    trees = [plain_levels(list(map(plain_leaf, g)), arity) for g in groups]
    top, out = plain_levels([t[-1][0] for t in trees], arity), []
    for k, (group, levels) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(group):
            proof = plain_proof(levels, i, arity) + plain_proof(top, k, arity)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = plain_leaf((*r[:3], r[3] + changed, r[4]) if changed else r)
            for slot, others in proof:
                now = plain_hash(*others[:slot], now, *others[slot:])
            out.append((r[0], plain_leaf(r), levels[-1][0], top[-1][0], "".join(x for _, run in proof for x in run), now))
    return sorted(out, key=str)


def odd_rows():
    r = random.Random(5)
    rows = [(i, r.choice(["a", None]), r.choice(["en", "en", "en", "dé", None, "", "zz"]), r.choice([3, None, -1, 2**62]), r.choice(["x", "", None, "é日😀", "long " * 5000])) for i in range(60)]
    return rows + [rows[4], rows[4], (None, "a", "en", 1, "t"), (None, None, None, None, None), (7, "b", "alone", 1, "only one"), (-3, "b", "two", 1, "x"), (-2, "b", "two", 1, "x")]


@pytest.mark.parametrize("arity,small", [(2, 5), (2, 16_384), (3, 0), (5, 20)])
def test_against_plain_trees(spark, monkeypatch, arity, small):
    """Levels of more than ``small`` nodes are joined, the rest is finished in one task."""
    monkeypatch.setattr(merkle, "SMALL_LEVEL", small)
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", tree string").withColumn("AT", F.lit(1))
    seventh = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    got = merkle.manifest(docs, SCHEMA.replace(" long", "").replace(" string", "").split(", "), "lang", "doc_id", arity, {"n_chars": docs["n_chars"] + 1}, seventh).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == brute(rows, arity)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and {r.verified for r in got} == {True, False}


def test_few_rows(spark):
    docs = spark.createDataFrame([(7, "s", None, 1, "x")], SCHEMA)
    row = merkle.tampered_documents(docs).first()
    assert row.leaf == row.subroot == row.root == plain_leaf((7, "s", None, 1, "x")) and row.proof_sha256 == plain_hash("")
    assert merkle.tampered_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(docs, ["text"], "lang", "doc_id", arity=1)


def test_changes_are_found(spark):
    """A changed leaf breaks its own proof, and only its own."""
    docs = spark.range(100).selectExpr("id AS doc_id", "'s' AS source", "if(id % 3 = 0, 'a', 'b') AS lang", "id AS n_chars", "'t' AS text")
    got = {r.doc_id: r.verified for r in merkle.tampered_documents(docs).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(100)}


def test_sql(spark, sf_dir):
    got = queries.op13_merkle_manifest(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.OP13_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert len(got) == 200 and got.equals(want[got.columns])
