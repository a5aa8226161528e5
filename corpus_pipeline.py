"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import decontaminate as decontamination
from graticule.llm import mixing, token_files, toxicity
from graticule.llm.common import cut, scratch_path, table
from graticule.llm.near_duplicates import deduplicated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.7 or more go; it learns from every labelled document."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_all=True)
    rows = toxicity.scored(docs.withColumn("body", F.col("text")), machine, COLUMNS, text="body")
    return rows.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return deduplicated(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any ten-word window of a benchmark item go."""
    found = decontamination.decontaminate(docs.withColumn("body", F.col("text")), table(spark, sf_dir, "benchmark"), COLUMNS, text="body")
    return found.where("n_hit = 0").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    # rows equal in id, size and source have one hash and are taken alike; rows that share an id alone are not
    keys = [F.col(k).alias(f"mixed_{k}") for k in ("doc_id", "size", "source")]
    times = mixed.where("taken > 0").select(*keys, (F.col("taken") / F.col("size")).cast("int").alias("times")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("mixed_doc_id")) & F.col("source").eqNullSafe(F.col("mixed_source")) & (F.col("words") == F.col("mixed_size"))
    taken = docs.select(*COLUMNS, mixing.word_count("text").alias("words")).join(times, same)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; per document its place in them."""
    import public_tokenizers

    folder = scratch_path(spark, "pipeline-tokens")
    encoded = token_files.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_files(token_files.write_files(encoded, folder), folder)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model, fingerprints and a tokenizer are beyond SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None
