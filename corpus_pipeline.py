"""Corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, contaminated documents go, sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrel.llm import decontam, jaccard_join, line_dedup, mixing, toxicity
from gridrel.llm.common import crc_mod, stash
from gridrel.llm.queries import TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC.  Null and empty texts are scored like texts without any known n-gram."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    return toxicity.score(docs, model, "__score").where(F.col("__score") < TOXIC).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that a later document holds; rows stay, null texts as they are."""
    return line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or similar texts; null and empty texts all stay."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; one passage in a long document is enough to drop it."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: for each slot of each output shard, the words of its block by document (doc_id, words and more)."""
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to shared storage and read again.

    Rows may repeat in any column, ids be null, and further columns pass through all stages but
    the last.  An empty table gives an empty mix.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: trained scores, and draws by hashes of Spark's own.
ORACLE_SQL = None
