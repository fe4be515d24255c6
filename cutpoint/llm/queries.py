"""The queries of this package, by name: functions of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutpoint.llm import (
    hard_negatives,
    mixing,
    near_copies,
    ngram_join,
    pieces,
    prefix_trie,
    quality_model,
    quality_rules,
    repeats,
    secrets,
    token_counts,
    toxicity,
    vector_search,
)
from cutpoint.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parent.parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pieces, with a digest of the ids, of the decoded text and of the pieces' byte spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, tokenizer(PIECE_MODEL))
    return coded.selectExpr(
        "doc_id",
        "CAST(length(ids) / 4 AS BIGINT) AS n_tokens",
        "sha2(ids, 256) AS ids_sha256",
        "sha2(CAST(decoded AS BINARY), 256) AS decoded_sha256",
        "sha2(concat(starts, ends), 256) AS spans_sha256",
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mixture of 150 % of the corpus takes of each document."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken", "copies")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the base rules and the learnt list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules, keep=["doc_id"])
    return judged.select("doc_id", *[f"stats.{c}" for c in quality_rules.COUNTS], "base_failed", "kept")


HELD_OUT = "pmod(crc32(coalesce(CAST(doc_id AS STRING), '')), 5) = 0"


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt without the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})")
    scored = quality_model.score(docs, quality_model.train(docs, labels), keep=["doc_id"])
    return scored.selectExpr("doc_id", f"{HELD_OUT} AS held_out", "score", "CAST(score >= 0.3 AS INT) AS predicted")


#: Chosen on the labelled rows that the model learns from, where clean texts stay well below.
TOXIC = 0.2


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, learnt without the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})")
    scored = toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id"])
    return scored.selectExpr(
        "doc_id", f"{HELD_OUT} AS held_out", "severity", "p_toxic", f"CAST(p_toxic >= {TOXIC} AS INT) AS toxic"
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a 200-byte string found elsewhere, and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    derive = {
        "n_bytes": "CAST(length(text) AS BIGINT)",
        "n_removed": "CAST(length(text) - length(kept) AS BIGINT)",
        "n_spans": "CAST(size(spans) AS BIGINT)",
        "kept_sha256": "sha2(kept, 256)",
    }
    return repeats.without_repeats(docs, carry=["doc_id"], derive=derive)


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector with all others."""
    return vector_search.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; class_id is the doc_id of its first row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_copies.classes(docs, carry=["doc_id"]).select("class", "first", "row.doc_id")
    firsts = found.where("first").selectExpr("class", "doc_id AS class_id")
    return found.join(firsts, "class").selectExpr("doc_id", "class_id", "NOT first AS duplicate")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, tokenizer(PIECE_MODEL), mark_alone=True).drop("text")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: counts and a digest of the base spans, all spans, live ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows, spans = secrets.find(docs)
    names = F.array(*[F.lit(k.name) for k in secrets.KINDS])
    listed = secrets.per_row(spans).withColumn("names", names)

    def joined(which: str) -> str:
        one = "concat(get(names, s.kind), ':', s.start, ':', s.end)"
        return f"array_join(transform(filter(spans, s -> {which}), s -> {one}), ',')"

    counts = [
        f"CAST(size(filter(coalesce(spans, array()), s -> s.kind = {i})) AS BIGINT) AS n_{k.name}"
        for i, k in enumerate(secrets.BASE)
    ]
    return rows.join(listed, "rid", "left").selectExpr(
        "row.doc_id AS doc_id",
        *counts,
        f"sha2(coalesce({joined('s.base')}, ''), 256) AS base_sha256",
        f"coalesce({joined('TRUE')}, '') AS spans",
        "CAST(size(filter(coalesce(spans, array()), s -> s.live)) AS BIGINT) AS n_live",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("owner")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that share 85 % of their 4-word shingles."""
    return ngram_join.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector; every seventh vector changes its label first."""
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label"
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", label))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pieces,
        op2_mixing,
        op3_quality_rules,
        op4_quality_model,
        op5_toxicity,
        op6_repeats,
        op7_vector_search,
        op8_near_copies,
        op9_token_counts,
        op10_secrets,
        op11_prefix_trie,
        op12_ngram_join,
        op13_hard_negatives,
    )
}
