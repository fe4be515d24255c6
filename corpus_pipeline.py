"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutpoint.llm import mixing, near_copies, pieces, quality_rules, secrets
from cutpoint.llm.queries import PIECE_MODEL, table, tokenizer
from cutpoint.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learnt list reject go."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_copies.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced; n_chars follows the text."""
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the byte spans of their pieces (packed little-endian unsigned 32-bit numbers)."""
    coded = pieces.encode(docs, tokenizer(PIECE_MODEL))
    return coded.selectExpr(
        "doc_id", "lang", "source", "CAST(length(ids) / 4 AS BIGINT) AS n_tokens", "ids", "starts", "ends",
        "decoded = coalesce(text, '') AS exact",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_copies", near_dedup),
    ("secrets", without_secrets),
    ("mixing", mix),
    ("pieces", encode),
]

#: The learnt list, the classes and the balanced sample have no SQL counterpart; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
