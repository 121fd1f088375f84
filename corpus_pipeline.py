"""A corpus pipeline of five stages: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor
kept; all but the last return the columns of ``documents``, whatever others there
are.  Defined cases: null texts and ids pass every filter, as a text that is null is
neither toxic, nor a copy, nor contaminated; an empty table gives an empty one;
rows that repeat an id are judged each by its own text, and of rows equal in id and
text one stays; a text of any length is read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roisight.llm import pii, toxicity
from roisight.llm._store import checkpointed, maybe_broadcast, removed, shared_folder
from roisight.llm.decontamination import decontaminate
from roisight.llm.ngram_join import jaccard_components
from roisight.llm.packing import pack


#: Near-copies share four fifths of their shingles of five words: a stage, unlike the query op3, has no contract of its own.
SHINGLE_WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; labels of the held-out fold are not learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, keep=toxicity.fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, carry=True).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near-copies; of rows that repeat an id and its text, the smallest row."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        return _drop_near_copies_by_text(docs)
    found = checkpointed(jaccard_components(docs, width=SHINGLE_WORDS, num=4, den=5).select("doc_id", "component_id"))
    copies = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(maybe_broadcast(copies, 8), "doc_id", "left_anti").select(*docs.columns)


def _drop_near_copies_by_text(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: each id with each of its texts (by a hash) is numbered and judged for itself."""
    key = ["doc_id", "_print"]
    printed = docs.withColumn("_print", F.xxhash64("text"))
    held = checkpointed(printed.where("doc_id IS NOT NULL").groupBy(*key).count())
    numbers = checkpointed(held.withColumn("_number", F.monotonically_increasing_id()))
    numbered = printed.join(numbers.drop("count"), key, "left")
    found = jaccard_components(numbered, id_col="_number", width=SHINGLE_WORDS, num=4, den=5).select(F.col("doc_id").alias("_number"), "component_id")
    members = found.where("_number IS NOT NULL").distinct().join(numbers, "_number")
    kept = checkpointed(members.groupBy("component_id").agg(F.min(F.struct(*key, "count")).alias("first")).select("first.*"))
    single = printed.join(kept.where("count = 1"), key, "left_semi").select(*docs.columns)
    several = printed.join(kept.where("count > 1"), key, "left_semi").groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return docs.where("doc_id IS NULL").unionByName(single).unionByName(several)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, carry=True).where("NOT contaminated").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; the character count follows."""
    stored = checkpointed(pii.extract(docs))
    patterns = checkpointed(pii.pattern_table(stored))
    row = F.struct(*docs.columns)
    found = pii.with_spans(pii.extract(docs.withColumn("row", row), keep=["row"]), patterns, stored=stored)
    changed = found.select("row", F.when(F.size("spans") > 0, pii.masked(F.col("row.text"), F.col("spans"))).alias("masked"))
    fresh = {"text": F.coalesce("masked", "row.text"), "n_chars": F.coalesce(F.char_length("masked").cast("long"), "row.n_chars") if "n_chars" in docs.columns else None}
    return changed.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece."""
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Fitted scores and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again; a stage's input goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    except Exception:
        removed(spark, folder)
        raise
