"""Registered queries of the training-data operators: name -> (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import oracle_sql
from opslens.llm.common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.language import languages

    return languages(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.quality import quality

    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.tokenfile import token_ids

    return token_ids(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.simhash import simhash_components

    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.licenses import licenses

    return licenses(read_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.secrets import digest, secrets

    return digest(secrets(read_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.mixing import mixture

    return mixture(read_table(spark, sf_dir, "documents"), weights=MIX).drop("text_hash", "place")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.decontaminate import matches

    found = matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "first_word", "n_slots")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.suffix import dedup_text, digest

    return digest(dedup_text(read_table(spark, sf_dir, "documents")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.conversations import damaged, digest, repair

    table = read_table(spark, sf_dir, "conversations")
    return digest(repair(damaged(table)), table)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.llm.jaccard import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"))


#: target weights of the mixture, by level of the tree
MIX = {"domain": {"domain0": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language, op2_toxicity, op3_quality, op4_token_ids, op5_simhash, op6_licenses, op7_secrets, op8_mixing, op9_decontamination, op10_suffix, op11_conversations, op12_collocations, op13_jaccard)
}
ORACLES: dict[str, str] = {
    "op11_conversations": oracle_sql.CONVERSATIONS, "op12_collocations": oracle_sql.COLLOCATIONS, "op13_jaccard": oracle_sql.JACCARD}
