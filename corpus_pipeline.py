"""A training corpus from documents: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results of every stage: it reads the columns of documents alone, so extra columns, whatever their names, are
left out; an empty table gives an empty table; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, mil_quality, mixing, ngram_join, secrets
from tracewright.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier gives less than the threshold. Repeated rows get one score and stay or
    go together; without labels every score is 0.5 and all stay."""
    model = mil_quality.learn(docs, table(spark, sf_dir, "labels"))
    return mil_quality.scored(docs.select(COLUMNS), model).filter(F.col("score") >= mil_quality.THRESHOLD).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, 0.8 or more): the least id, rows without an id
    last. A row repeated with id and text is one; texts without words are linked with nothing and stay."""
    return ngram_join.deduplicated(docs.select(COLUMNS), width=5, num=8, den=10)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark; items without words match nothing. Repeated rows
    stay or go together."""
    return decontaminate.decontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document and repeated row stays."""
    own = docs.select(COLUMNS)
    found = secrets.redacted(own, secrets.train(secrets.labelled_samples(own)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate the documents so that the sources reach their target weights. A null source is the empty one; equal
    ids get equal counts."""
    own = docs.select(COLUMNS)
    return mixing.mixed(own, mixing.rates(own, mixing.target_weights(own)), mixing.SEED).select(*COLUMNS, "replica")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("mixture", mixture),
]

#: Learned and iterative stages have no SQL form; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
