"""The operators as queries over a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm import alignment, cascade, containment, forest, linetree, mixing, packing, phrases, pii, rules, simhash, templates, toxicity
from martlet.llm.common import table

# The host and path rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Words of host names that put a host on the block list.
HOST_WORDS = ["adult", "ads", "bet", "bets", "casino", "gambling", "loan", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx"]


def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("source")


def op2_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_private(table(spark, folder, "documents"))


def op4_simhash_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_site_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.main_texts(table(spark, folder, "pages"))


def op6_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return cascade.judge(table(spark, folder, "pages"), rules, HOST_WORDS)


def op7_toxic_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = linetree.drop_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", cleaned["__lines"].alias("n_lines"), cleaned["__dropped"].alias("n_dropped"), "text")


def op9_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return rules.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_minhash_containment(spark: SparkSession, folder: str) -> DataFrame:
    return containment.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_pointer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_misra_gries_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_projection_forest": op2_projection_forest,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_simhash_blocks": op4_simhash_blocks,
    "op5_site_templates": op5_site_templates,
    "op6_url_cascade": op6_url_cascade,
    "op7_toxic_lexicon": op7_toxic_lexicon,
    "op8_line_templates": op8_line_templates,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_minhash_containment": op10_minhash_containment,
    "op11_pointer_alignment": op11_pointer_alignment,
    "op12_misra_gries_phrases": op12_misra_gries_phrases,
    "op13_pattern_packing": op13_pattern_packing,
}
