"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import sql
from foldspark.llm.conversation_repair import damage, repair_report
from foldspark.llm.dart_minhash import near_duplicates
from foldspark.llm.decontaminate import contaminated, contamination
from foldspark.llm.language_mixture import languages
from foldspark.llm.licenses import RULES, SENTENCES, license_scan
from foldspark.llm.line_dedup import dedup_lines
from foldspark.llm.lm_scoring import score_documents
from foldspark.llm.mixing import mixture
from foldspark.llm.prefix_trie import rebuilt, trie_of, turn_digests
from foldspark.llm.quality_rules import quality_rules
from foldspark.llm.recompression import remove_repeats
from foldspark.llm.rule_ensemble import quality_scores
from foldspark.llm.sharding import LAW, placements

QUERIES = {}
ORACLES = {}


def register(name: str, text: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if text is not None:
            ORACLES[name] = text
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op3_quality_rules", sql.QUALITY_RULES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_decontamination", sql.DECONTAMINATION)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, contaminated().alias("contaminated"))


@register("op1_source_mixing", sql.MIXING)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("k")


@register("op5_license_scan", sql.license_sql(SENTENCES, RULES))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@register("op10_near_duplicates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@register("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return cut.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), digest)


@register("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k")


@register("op4_language_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@register("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@register("op6_substring_dedup", sql.SUBSTRING_DEDUP)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op11_sharding", sql.SHARDING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placements(table(spark, sf_dir, "documents"), shards=16).select("doc_id", "size", "text_crc32", "shard", "slot")
    return placed.withColumns({"law": F.lit(LAW), "grown_shard": F.lit(None).cast("int")})


@register("op13_conversation_repair", sql.CONVERSATION_REPAIR)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair_report(damage(talks), talks.select("conv_id"))


@register("op12_prefix_trie", sql.PREFIX_TRIE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_of(rebuilt(turn_digests(table(spark, sf_dir, "conversations"))))
