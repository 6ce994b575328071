"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate group stays, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, ngram_join, packing, secrets, toxicity
from tidemark.llm.common import materialize


def _as_before(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars follows the text."""
    return new.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay; null, empty and blank texts score 0."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.with_score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of a source, three at least, go; every document stays, null and empty texts as they are."""
    return _as_before(lines.drop_lines(docs, least=3), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the smallest id stays; rows without an id stay."""
    found = ngram_join.jaccard_join(docs, n=5, num=80, den=100)
    return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are masked; every document stays, null and empty texts as they are."""
    return _as_before(secrets.mask_secrets(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one a row, with their ids; a null or empty text is its end token alone."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("ngram_jaccard", drop_near_copies), ("secret_scans", mask_secrets), ("packing", pack)]
#: A classifier, hashed sets and a tokenizer are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
