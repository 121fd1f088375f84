"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roisight.llm import oracle, quality, toxicity
from roisight.llm._digest import span_digests
from roisight.llm._store import checkpointed
from roisight.llm.ann import build_index, search
from roisight.llm.chat_format import format_conversations, learned_text, turns_text
from roisight.llm.decontamination import decontaminate
from roisight.llm.ngram_join import jaccard_components
from roisight.llm.packing import pack
from roisight.llm.pii import find_pii
from roisight.llm.secrets import scan_secrets
from roisight.llm.substring_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_digests("spans", ["email", "ip", "card", "phone"]))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    index = checkpointed(build_index(vectors))
    return search(index, vectors.where("vec_id % 50 = 0"), k=5, factor=1.0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    out = format_conversations(table.unionByName(more)).withColumn("learned", learned_text("formatted", "loss_mask"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text("turns"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels, keep=toxicity.fold("doc_id", 5) != 0)
    out = toxicity.score(documents, model)
    return out.select("doc_id", (toxicity.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, _table(spark, sf_dir, "labels"), keep=toxicity.fold("doc_id", 4) != 2)
    score = quality.compile_rules(model)
    scored = quality.describe(documents).select("doc_id", (toxicity.fold("doc_id", 4) == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_digests("spans", ["assign", "access", "hex"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_chat_format": op2_chat_format, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_toxicity": op4_toxicity, "op5_substring_dedup": op5_substring_dedup, "op6_quality": op6_quality, "op7_secrets": op7_secrets, "op8_pii": op8_pii, "op9_nearest": op9_nearest, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": oracle.DECONTAMINATION, "op2_chat_format": oracle.CHAT_FORMAT, "op3_ngram_jaccard": oracle.NGRAM_JACCARD, "op5_substring_dedup": oracle.SUBSTRING_DEDUP, "op9_nearest": oracle.NEAREST}
