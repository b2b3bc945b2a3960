"""Merkle manifest of a table: a digest of each row, trees over the rows of each group, and a tree over the groups.

A node is known by its tree and its place in its level. Each level is one equijoin of its nodes with
themselves on the computed place of the sibling (XOR 1 in binary trees, a shifted slot in wider ones); the
rows in slot zero, which then hold the digests of their whole run, emit the parents. So a level of any size is
spread by (tree, place), and the nodes of all levels together are fewer than twice the leaves. A level of few
nodes isn't worth a job: one task then looks siblings up for what is left. Proofs go down the same levels: a node's
path is its siblings and then its parent's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.llm.common import cut

HEX = 64
#: What is left of all levels is finished in one task once a level has so few nodes.
SMALL_LEVEL = 16_384
#: Proofs go down so many levels in one plan.
JOINED_LEVELS = 4


def digest(*texts: Column) -> Column:
    """Lowercase hex sha256 of the texts in turn."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def field(value: Column) -> Column:
    """What a row's digest takes of one field: ``-`` for null, else its UTF-8 byte count, a colon, and it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _joined(digests: Sequence[Column]) -> Column:
    return F.concat(*(F.coalesce(d, F.lit(b"")) for d in digests))


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``tree`` (the place of its group among all, null first), ``at`` (its place in the tree) and ``n`` (the tree's leaves).

    Rows are dealt by ranges of group and order. Each range numbers its own rows; what lies before it comes from
    one row for each group and range.
    """
    order = [F.col(c).asc_nulls_first() for c in ("group", "order", "leaf", "uid")]
    dealt = cut(leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    by_range = Window.partitionBy("group").orderBy("part")
    counts = dealt.groupBy("part", "group").agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(by_range) - F.col("rows"))
    counts = counts.withColumn("n", F.sum("rows").over(Window.partitionBy("group"))).withColumn("starts", F.when(F.col("before") == 0, 1).otherwise(0))
    in_range = Window.partitionBy("part").orderBy(F.col("group").asc_nulls_first())
    counts = counts.withColumn("started", F.sum("starts").over(in_range))
    parts = counts.groupBy("part").agg(F.sum("starts").alias("all_started"))  # one row for each range
    parts = parts.select("part", (F.sum("all_started").over(Window.orderBy("part")) - F.col("all_started")).alias("started_before"))
    offsets = counts.join(parts, "part").select("part", F.col("group").alias("of"), "before", "n", (F.col("started") + F.col("started_before") - 1).alias("tree"))
    numbered = dealt.withColumn("in_part", F.row_number().over(Window.partitionBy("part", "group").orderBy(*order)))
    both = numbered.alias("l").join(offsets.alias("r"), (F.col("l.part") == F.col("r.part")) & F.col("group").eqNullSafe(F.col("of")))
    rest = [c for c in leaves.columns if c not in ("group", "order", "uid", "leaf")]
    return both.select("tree", (F.col("in_part") + F.col("before") - 1).alias("at"), "n", F.unhex("leaf").alias("digest"), *rest)


def _finished(nodes: DataFrame, arity: int) -> DataFrame:
    """tree, at, path (siblings up to the tree's root) and subroot of a few nodes of one level, by all further levels in one task."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = {(tree, at): (n, raw) for batch in batches for tree, at, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        levels = [level]
        while any(n > 1 for n, _ in level.values()):
            runs = {(tree, at // arity): (n, [level[tree, at + s][1].hex() for s in range(min(arity, n - at))]) for (tree, at), (n, _) in level.items() if n > 1 and at % arity == 0}
            level = {place: (-(-n // arity), hashlib.sha256("".join(run).encode()).digest()) for place, (n, run) in runs.items()}
            levels.append(level)
        known: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        for level in reversed(levels):
            above, known = known, {}
            for (tree, at), (n, raw) in level.items():
                first = at - at % arity
                siblings = [level[tree, s][1] for s in range(first, min(first + arity, n)) if s != at]
                path, root = above[tree, at // arity] if n > 1 else (b"", raw)
                known[tree, at] = (b"".join([*siblings, path]), root)
        rows = [(tree, at, path, root) for (tree, at), (path, root) in known.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["tree", "at", "path", "subroot"])

    whole = nodes.select(F.col("tree").cast("long").alias("tree"), F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "digest")
    return whole.coalesce(1).mapInArrow(climb, "tree long, at long, path binary, subroot binary")


def _grown(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """All trees of ``leaves``: their large levels (nodes with ``siblings``, left to right), the nodes that were roots at each of
    these levels, and tree, at, path and subroot of the first level above them."""
    slot = F.col("at") % arity
    nodes, levels, roots = leaves, [], []
    total, most, trees = nodes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    while most > 1 and total > SMALL_LEVEL:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        nodes = nodes.where("n > 1")
        level = nodes
        for shift in range(1, arity):
            beside = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + (slot + shift) % arity
            other = nodes.select(F.col("tree").alias("other_tree"), F.col("at").alias("other_at"), F.col("digest").alias(f"d{shift}"))
            level = level.join(other, (F.col("tree") == F.col("other_tree")) & (beside == F.col("other_at")), "left").drop("other_tree", "other_at")
        # The digest in slot j, seen from slot s, is the one shifted by j - s.
        in_slot = [F.coalesce(*(F.when(slot == s, F.col(f"d{(j - s) % arity}")) for s in range(arity) if s != j)) for j in range(arity)]
        level = cut(level.withColumn("siblings", _joined(in_slot)))
        levels.append(level)
        run = [_hex(F.col("digest")), *(F.coalesce(_hex(F.col(f"d{shift}")), F.lit("")) for shift in range(1, arity))]
        nodes = level.where(slot == 0).select("tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.unhex(digest(*run)).alias("digest"))
        most, total = -(-most // arity), total // arity + trees
    if most > 1:
        return levels, roots, cut(_finished(nodes, arity))
    return levels, roots, nodes.select("tree", "at", F.lit(b"").alias("path"), F.col("digest").alias("subroot"))


def _paths(leaves: DataFrame, levels: list[DataFrame], rest: DataFrame, tops: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with ``path``, all siblings up to the end of ``tops``, and ``subroot``; ``tops`` has a tree's depth, root and path."""
    ends = tops.select(F.col("tree").alias("end_tree"), F.col("path").alias("end_path"))
    above = rest.join(ends, F.col("tree") == F.col("end_tree")).select("tree", "at", F.concat("path", "end_path").alias("path"), "subroot")
    for depth in range(len(levels) - 1, -1, -1):
        found = _below(levels[depth], above, f"at div {arity}", "siblings")
        if depth:
            single = tops.where(F.col("depth") == depth).select("tree", F.lit(0).cast("long").alias("at"), "path", "subroot")
            above = found.select("tree", "at", "path", "subroot").unionByName(single)
            above = above if depth % JOINED_LEVELS else cut(above)
    columns = [*leaves.columns, "path", "subroot"]
    if not levels:
        return _below(leaves, above, "at", None).select(*columns)
    single = leaves.where("n = 1").join(tops.where("depth = 0").select("tree", "path", "subroot"), "tree")
    return found.select(*columns).unionByName(single.select(*columns))


def _below(nodes: DataFrame, above: DataFrame, parent: str, siblings: str | None) -> DataFrame:
    """``nodes`` with the paths of the nodes ``above`` at place ``parent``, led by their own siblings."""
    up = above.select(F.col("tree").alias("up_tree"), F.col("at").alias("up_at"), F.col("path").alias("up_path"), "subroot")
    met = nodes.join(up, (F.col("tree") == F.col("up_tree")) & (F.expr(parent) == F.col("up_at")))
    return met.withColumn("path", F.concat(siblings, "up_path") if siblings else F.col("up_path"))


def _depth(n: Column, arity: int) -> Column:
    """Levels above ``n`` leaves: powers of the arity below n."""
    powers = [arity**k for k in range(64) if arity**k < 2**62]
    return reduce(lambda a, b: a + b, ((n > p).cast("int") for p in powers))


def _folded(start: Column, path: Column, skip: Column, at: Column, n: Column, arity: int) -> tuple[Column, Column]:
    """The root that leaf ``start`` at place ``at`` of ``n`` gives with the siblings in hex ``path`` from the ``skip``-th on, and where it stopped."""

    def up(state: Column, _: Column) -> Column:
        slot = state["at"] % arity
        others = F.least(F.lit(arity).cast("long"), state["n"] - state["at"] + slot) - 1
        left = F.substring(path, (state["skip"] * HEX + 1).cast("int"), (slot * HEX).cast("int"))
        right = F.substring(path, ((state["skip"] + slot) * HEX + 1).cast("int"), ((others - slot) * HEX).cast("int"))
        return F.struct(
            digest(left, state["digest"], right).alias("digest"), (state["skip"] + others).alias("skip"),
            F.floor(state["at"] / arity).cast("long").alias("at"), F.floor((state["n"] + arity - 1) / arity).cast("long").alias("n"),
        )

    begin = F.struct(start.alias("digest"), skip.cast("long").alias("skip"), at.cast("long").alias("at"), n.cast("long").alias("n"))
    steps = F.array_repeat(F.lit(0), _depth(n, arity))
    end = F.aggregate(steps, begin, up)
    return end["digest"], end["skip"]


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, arity: int = 2, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``order``, leaf, subroot, root, proof (hex), folded_root and verified.

    A leaf is the digest of the row's ``fields``. The leaves of a ``group`` (null is a group of its own) ascend by
    ``order`` (null first; equal ones by digest, repeated rows are leaves of their own); every ``arity``
    consecutive nodes become the digest of their digests, until one remains, the group's subroot (a lone leaf
    is one). The subroots, by group (null first, by UTF-8 bytes), give the root in the same way. ``proof`` is the siblings,
    level by level up to the root, each level from left to right. folded_root is worked out anew from leaf and
    proof, where ``where`` holds from the leaf of the row with its columns ``changed``; verified says whether it is the root.
    An empty table gives no rows. Other columns don't matter, whatever their names; no column may be named twice.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    now = digest(*(field(docs[f]) for f in fields))
    then = digest(*(field((changed or {}).get(f, docs[f])) for f in fields))
    checked = F.when(F.coalesce(where, F.lit(False)), F.unhex(then)) if where is not None else F.lit(None).cast("binary")
    rows = docs.select(docs[group].alias("group"), docs[order].alias("order"), docs[order].alias("key"), now.alias("leaf"), checked.alias("checked"))
    leaves = cut(_numbered(cut(rows.withColumn("uid", F.monotonically_increasing_id()))))
    levels, roots, rest = _grown(leaves, arity)
    ended = [r.select("tree", "digest", F.lit(depth).alias("depth")) for depth, r in enumerate(roots)]
    ended.append(rest.where("at = 0").select("tree", F.col("subroot").alias("digest"), F.lit(len(levels)).alias("depth")))
    subroots = cut(reduce(DataFrame.unionByName, ended))
    trees = subroots.count()
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").cast("long").alias("at"), F.lit(trees).cast("long").alias("n"), "digest", F.col("tree").alias("below"), "depth")
    top_levels, _, top_rest = _grown(top, arity)
    last = top_rest.select("subroot").first()
    root = bytes(last[0]).hex() if last else None
    end = top.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit(len(top_levels)).alias("depth"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))
    tops = cut(_paths(top, top_levels, top_rest, end, arity).select(F.col("below").alias("tree"), "depth", "path", F.col("digest").alias("subroot")))
    proven = _paths(leaves, levels, rest, tops, arity)
    text = proven.select("key", "at", "n", F.col("tree").alias("group_at"), _hex(F.col("digest")).alias("leaf"), _hex(F.coalesce("checked", "digest")).alias("start"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("path")).alias("proof"))
    sub, used = _folded(F.col("start"), F.col("proof"), F.lit(0), F.col("at"), F.col("n"), arity)
    folded = text.withColumn("half", F.struct(sub.alias("digest"), used.alias("used")))
    whole, _ = _folded(F.col("half.digest"), F.col("proof"), F.col("half.used"), F.col("group_at"), F.lit(trees), arity)
    return folded.select(F.col("key").alias(order), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", whole.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents in which one is added to n_chars wherever 7 divides the id's crc32, and the proofs' digests."""
    seventh = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", changed={"n_chars": docs["n_chars"] + 1}, where=seventh)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
