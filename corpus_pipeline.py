"""Corpus pipeline: quality, toxicity, near duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.  A stage that needs labels or the benchmark reads
them from sf_dir and is fitted on the documents that it gets.

Defined cases: texts that are null or empty are judged like any other, are no near duplicates of each other and have no
tokens; rows with a null id are kept, judged and never taught from; of repeated rows one stays, if the text has a word;
without labels, or without documents that have one, the classifiers reject nothing; too few labels of a class are an error;
an empty benchmark finds nothing; empty documents give an empty result; further columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vulnlake.llm import bpe_trie, decontaminate, ngram_join, quality, toxicity
from vulnlake.llm.common import materialise, release
from vulnlake.llm.queries import vocabulary_path


#: Tables that the result of a stage reads; run() releases them once the result is written.
_HELD: list[DataFrame] = []


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, quality.train(docs, _labels(spark, sf_dir)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return ngram_join.keep_first(docs, held=_HELD)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, decontaminate.fit_space(docs, benchmark))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_trie.encode_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: The classifiers and the latent space can't be written in SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
        while _HELD:
            release(_HELD.pop())
        if i:
            release(docs)
        docs = done
    return docs
