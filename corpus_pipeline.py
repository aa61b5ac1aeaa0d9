"""From raw documents to token ids: rules, line dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on everything the stage before it kept and returns the
columns of ``documents``; the last one returns a digest of each document's token ids.

Edge cases follow the operators: a null text fails the rules; a text whose lines are all frequent
stays as an empty one; rows that repeat both doc_id and text share one fate; of documents that tie as
copies the least doc_id stays; empty tables give none; texts of any length are one row; further
columns pass through under whatever name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import decontam, lines, neardup, queries, rules
from vellumine.llm.scratch import clear, staged, written

#: Keys of rejected documents (24 bytes each) sent to all executors at most; more are joined by shuffling.
BROADCAST_ROWS = 2_000_000


def _without(docs: DataFrame, rejected: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``docs`` less those in ``rejected``; ``keys`` gives an expression over docs for each of its columns."""
    gone = staged(rejected.distinct(), "rejected")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    on = [F.expr(mine).eqNullSafe(gone[theirs]) for theirs, mine in keys.items()]
    return docs.join(gone, on, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy of the rule ledger."""
    return rules.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave all of them; n_chars follows."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    whole = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("others"))  # in one column, whatever their names
    left = lines.drop_frequent_lines(whole, min_docs=10, carry=("others",)).select("doc_id", "text", "others.*")
    kept = left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group: five-word shingles, similarity 0.8 or more."""
    found = neardup.near_duplicates(docs, n=5, percent=80)
    return _without(docs, found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")), {"gone_id": "doc_id"})


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words are within benchmark windows."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    return _without(docs, bad, {"gone_id": "doc_id", "gone_hash": "xxhash64(text)"})


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return queries.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The last stage's merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        begun = written()
        docs = staged(stage(spark, docs, sf_dir), name)
        clear(spark, begun, keep=1)  # what the stage itself has staged
    return STAGES[-1][1](spark, docs, sf_dir)
