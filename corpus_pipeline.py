"""Documents to token ids: language, near duplicates, source mix, encoding.

Every stage works on all that the one before it kept, and its own decisions take effect: the language stage
drops documents in no language, the near-duplicate stage all but one document of each class, the mix drops and
repeats documents by their source's target. All but the last return the columns of ``documents``; the last
returns one row of ids per document of the mix.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import bagminhash, bytebpe, language, mixing
from gleanery.llm.queries import byte_codec, table
from gleanery.session import shared_dir, ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter go."""
    ship_package(spark)
    return language.keep(docs, language.train(docs.where(language.fold("doc_id") != 0)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship_package(spark)
    return bagminhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship_package(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) per document of the mix."""
    ship_package(spark)
    return bytebpe.encode(docs, byte_codec())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: SQL cannot express the first two stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
