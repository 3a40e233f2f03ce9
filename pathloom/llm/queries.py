"""The text operators bound to the tables of a data folder: one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, linededup, mixing, ogg, oracles, quality, simhash, tokenids, toxicity
from .common import fold_of, stored, table

#: Set to use another vocabulary file.
TOKENIZER: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _learn_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, _learn_from(spark, sf_dir))), 0.5)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 3) != 1))
    return langid.predict(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(table(spark, sf_dir, "documents"))


def quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, _learn_from(spark, sf_dir))), quality.THRESHOLD)


def media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.inspect(stored(ogg.encode(table(spark, sf_dir, "documents")), "ogg-media"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.read_back(stored(chat.format_turns(rows.unionByName(own)), "chat-pieces"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.read_index(tokenids.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.digest(linededup.dedup(docs, linededup.LineState.empty(spark, id_type=docs.schema["doc_id"].dataType.simpleString()).insert(docs)))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_lexicon": toxicity_lexicon,
    "op2_language_id": language_id,
    "op3_decontamination": decontamination,
    "op4_source_mixing": source_mixing,
    "op5_quality_pairs": quality_pairs,
    "op6_media_ogg": media_ogg,
    "op7_chat_format": chat_format,
    "op8_token_ids": token_ids,
    "op9_line_dedup": line_dedup,
    "op10_simhash_near_dedup": simhash_near_dedup,
}

ORACLE: dict[str, str] = {
    "op3_decontamination": oracles.DECONTAMINATION,
    "op4_source_mixing": oracles.MIXING,
    "op7_chat_format": oracles.CHAT_FORMAT,
    "op9_line_dedup": oracles.LINE_DEDUP,
}
