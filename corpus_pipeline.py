"""Five stages from raw documents to token ids; each is written as Parquet and read by the next.

Quality rules drop poor and depleted documents and the lines that many documents of a host share; the
Jaccard join keeps one document of each group of copies; documents with benchmark passages go;
secrets are masked; what is left is encoded.  All but the last return the columns of documents, with
``n_chars`` brought up to date where a stage changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, chosen_path, decontaminate, quality, secrets
from kindred.llm.queries import tokenizer_path
from kindred.sources.shared import save_stage


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.share(spark, bpe.read_vocabulary(tokenizer_path())))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding", encoding),
]

#: Stages 2, 4 and 5 have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save_stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
