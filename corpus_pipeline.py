"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before has kept, as a table written and read again, so a lost executor repeats part of one
stage at most. Stages are judged by what they return: documents with the columns of the table documents, at last pieces.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import language, lines, mixing, packing, simhash
from leafmill.llm.common import shared_folder

#: In shorter lines, one edit makes another line ("Part 1", "Part 2"); there only equal ones are dropped.
NEAR_LINES = 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told, with that as their lang; the others (no letters, no text) go.

    Where nothing can be learned from, documents keep the lang that they came with.
    """
    # Who labelled a text as unknown says nothing to learn from.
    network = language.train(docs.where(F.col("lang") != language.UNKNOWN))
    if network is None:
        # Nothing tells the languages apart; what can't be in any goes all the same.
        return docs.where(language.lettered(F.col("text"))).select(*COLUMNS)
    told = language.predict(docs.select(*COLUMNS), network)
    return told.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those of which nothing is left go."""
    kept = lines.dedup_lines(docs.select(*COLUMNS), near_from=NEAR_LINES).where("n_dropped < n_lines")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL stands for a trained network, so not for the whole either; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    # Where Python workers share this folder, they find the package here.
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    jvm = spark.sparkContext._jvm
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            # What is written doesn't need the stage before any more.
            done = jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return docs
