"""From documents to token files: five stages, each over all that the one before has kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. ``run`` applies them to the documents table and
deletes a stage's intermediate tables as soon as its result is written.
All but the last stage return the columns they were given, whatever their names. Null ids and texts, empty
and very long texts, ties, repeated rows and empty tables are handled as the operators' docstrings say: a null
text counts as an empty one, rows are told apart even where they share an id, and of null and wordless texts,
which have one fingerprint, near_duplicates keeps one.
ORACLE_SQL is None: the stages train a classifier, hash and tokenize, which SQL cannot express; the tests
hold ``run`` against a brute-force version instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontaminate import without_contaminated
from millrace.llm.mixing import mixed
from millrace.llm.simhash import one_of_each
from millrace.llm.storage import Work, recorded
from millrace.llm.tokens import tokens_roundtrip
from millrace.llm.toxicity import without_toxic
from millrace.plans.shipping import ship

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weakly supervised classifier rejects."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash fingerprints."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold an item of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that the sources meet their target weights; a document drawn twice is there twice."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what they hold for each document."""
    return tokens_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result goes through the shared folder."""
    ship(spark)
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        left: list[Work] = []
        with recorded(left):
            out = stage(spark, docs, sf_dir)
        docs = work.keep(out, name)
        for other in left:
            other.drop(other.root)
    return docs
