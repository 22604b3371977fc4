"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import alignment, bpe, chosenpath, collocations, crf, decontaminate, licenses, packing, passages, pii, rules, secrets, sharding
from ledgerloom.llm.tables import read


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.op1_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2_secrets(read(spark, sf_dir, "documents"))


def op3_fuzzy_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op3_licenses(read(spark, sf_dir, "documents"))


def op4_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4_decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_permutation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5_shards(read(spark, sf_dir, "documents"))


def op6_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op6_rules(read(spark, sf_dir, "documents"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.op7_near_duplicates(read(spark, sf_dir, "documents"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """The key is the caller's, or that of the session setting; without either the one of tests."""
    held = spark.conf.get(pii.KEY_SETTING, None)
    return pii.op8_pseudonyms(read(spark, sf_dir, "documents"), key or (held.encode() if held else pii.DEFAULT_KEY))


def op9_word_shuffle_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    return bpe.op9_bpe(read(spark, sf_dir, "documents"), bpe.load_ranks(path), public_tokenizers.PATTERN)


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.op10_repeats(read(spark, sf_dir, "documents"))


def op11_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op11_collocations(read(spark, sf_dir, "documents"))


def op12_galloping_alignment(
    spark: SparkSession, sf_dir: str, a: str = public_tokenizers.path("byte_bpe_50k.json"), b: str = public_tokenizers.path("piece_bpe_32k.model")
) -> DataFrame:
    with open(a, encoding="utf-8") as one, open(b, "rb") as two:
        return alignment.op12_align(read(spark, sf_dir, "documents"), one.read(), two.read())


def op13_minimum_slack_packing(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    with open(path, encoding="utf-8") as file:
        return packing.op13_pack(read(spark, sf_dir, "documents"), file.read())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_crf_quality,
        op2_zstd_secrets,
        op3_fuzzy_licenses,
        op4_suffix_decontamination,
        op5_permutation_shards,
        op6_adaptive_rules,
        op7_chosen_path,
        op8_feistel_pseudonyms,
        op9_word_shuffle_bpe,
        op10_phrase_automata,
        op11_son_collocations,
        op12_galloping_alignment,
        op13_minimum_slack_packing,
    )
}
ORACLES: dict[str, str] = {"op11_son_collocations": collocations.SQL}
