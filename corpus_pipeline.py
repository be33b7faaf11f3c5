"""A pipeline over `documents`: quality rules, near duplicates, personal data, mix of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Null texts fail
the quality rules. Repeated rows are near duplicates of each other, so one of them stays; rows with
a null doc_id stay if their group has no other. Documents that the mix takes twice are packed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ploidlens.llm import common, jaccard, mixing, packing, pii, quality

#: Near duplicates: words of a shingle, and the similarity from which on documents are linked.
SHINGLE, NUM, DEN = 5, 80, 100


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    common.tune(spark)
    return quality.judged(docs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    common.tune(spark)
    return jaccard.one_of_each(docs, SHINGLE, NUM, DEN)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    common.tune(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    common.tune(spark)
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with sequence and offset."""
    import public_tokenizers

    common.tune(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]
#: Perplexities and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
