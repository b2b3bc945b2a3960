"""What the training-data operators share: table access, words, and cutting lineage."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set (tests on one machine), a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """For each wanted name one like it that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in wanted:
        out[name] = next(x for i in itertools.count() if (x := f"_{name}{i or ''}").lower() not in taken)
        taken.add(out[name].lower())
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text, with null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows kept from every fit: crc32 of the id's decimal text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def smallest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest 64-bit hashes in column ``order``.

    A count tells below which hash about twice as many rows lie, so that tasks send the final pick few
    rows each, however many tasks there are; only where that was too few are all taken.
    """
    total = rows.count()
    if total > 4 * n:
        below = rows.where(F.col(order) < F.lit(-(2**63) + int(2**64 * 2 * n / total)))
        if below.count() >= n:
            rows = below
    return rows.orderBy(order, *(c for c in rows.columns if c != order)).limit(n)
