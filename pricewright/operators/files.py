"""Imports from and exports to row files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only on one machine a temporary one takes its place."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that its plan ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def exported(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as ``csv`` or ``json`` and read back under its own schema, nulls and all."""
    folder = scratch(df.sparkSession)
    options = {"header": True, "nullValue": "\\N", "escape": '"'} if kind == "csv" else {}
    df.write.format(kind).options(**options).save(folder)
    return df.sparkSession.read.schema(df.schema).format(kind).options(**options).load(folder)


def rebuilt(df: DataFrame, folder: str) -> DataFrame:
    """A summary that replaces whatever was in ``folder``."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)
