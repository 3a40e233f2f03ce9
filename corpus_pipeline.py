"""From raw documents to token ids: five operators in a row.

Each stage takes all that the one before kept and returns the rows it keeps with
their columns as they are; the last returns the index of the token shards.  A
stage's result is written as Parquet on shared storage and read again, so a lost
executor costs one stage at most.

Defined cases: documents with a null or empty text, or without a letter, go in the
first stage, as do all if no document has a language to learn from; of repeated
rows one stays, rows with a null doc_id stay in the second stage and come first in
the last; very long texts are read whole by every stage; an empty table gives an
empty index; other columns, whatever their names, are kept as they are up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common, decontam, langid, mixing, queries, simhash, tokenids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with no language above even odds go."""
    model = langid.fit(docs.where(common.fold_of(F.col("doc_id"), 3) != 1))
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean_only(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest sample whose sources, languages and topics have the target shares."""
    return mixing.draw(docs, keep=None)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; each document's place in them, read back."""
    return tokenids.read_index(tokenids.write_shards(docs, queries.tokenizer_path()))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: SQL has neither the classifier, XXH64 with a seed nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k}")
    return docs
