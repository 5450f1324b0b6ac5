"""From raw documents to a training mix: quality, near copies, benchmark passages, personal data, source weights.

Each stage takes all rows that its predecessor kept and works on whole texts. All but the last return the
columns of `documents`; the last returns the mix, as pieces of documents in their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontaminate, mixing, neardup, pseudonyms, quality
from millrace.llm.queries import key_of
from millrace.llm.words import fresh
from millrace.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Rows without words go."""
    name = fresh(docs, "judged")
    return quality.judge(docs, name).filter(f"{name}.kept").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id."""
    return neardup.survivors(docs, neardup.near_duplicates(docs)).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    name = fresh(docs, "found")
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    contaminated = decontaminate.verdict(name)[-1]
    return found.filter(~contaminated).select(*docs.columns)


def hide_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data pseudonymised; n_chars follows the new text. No row goes."""
    name = fresh(docs, "found")
    new = pseudonyms.pseudonymise(docs, name, key_of(spark), keep=docs.columns)
    changed = {"text": F.col(f"{name}.text"), "n_chars": F.length(f"{name}.text").cast(docs.schema["n_chars"].dataType)}
    return new.withColumns({c: F.when(F.col(f"{name}.n_replaced") > 0, v).otherwise(F.col(c)) for c, v in changed.items()}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: shard, slot, epoch, source, block, doc_id, from_word, n_words, words."""
    mix = mixing.plan(docs, keep=["doc_id", "source", "text"])
    return mixing.mixed(mix, "text").select("shard", "slot", "epoch", "source", "block", "doc_id", "from_word", "n_words", "words")


STAGES = [("quality", keep_good), ("near copies", drop_copies), ("benchmark", drop_benchmark), ("personal data", hide_people), ("mix", mix_sources)]

# Near-copy classes, keyed permutations and seeded draws aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
