"""The corpus pipeline: documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import langid, mixing, near_dup, packing, pii
from pricewright.llm.common import shared_folder

#: The registered pipeline's key for pseudonyms; a real run brings its own secret.
DEMO_KEY = "registered pipeline"


#: A text goes if its score is under this many times an even guess among the learned languages.
LEAST_TIMES_EVEN = 1.1


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is recognised; texts without a letter go.

    A text goes too if the network hardly prefers its language to an even guess: with four languages, under a score of
    0.275. That bound is the same for tables of any size. Without any document to learn from, no text with a letter goes.
    """
    network = langid.fit(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # The document rides along as one struct, so none of its columns can clash.
    found = langid.identify(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text"), network)
    even = 1 / len(network.languages)
    known = F.col("score") >= LEAST_TIMES_EVEN * even if len(network.languages) > 1 else F.lit(True)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & known).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id."""
    return near_dup.one_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format; n_chars follows the new text."""
    return pii.pseudonymise(docs, DEMO_KEY, count=None).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stretches of documents that the mix takes; a document can come twice, in part, or not at all."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the stretches, packed into sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express these stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage results go to the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
