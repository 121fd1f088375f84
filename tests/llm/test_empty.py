"""Every operator on empty tables, and on columns of nulls only."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from roisight.llm import pii, quality, secrets, toxicity
from roisight.llm.ann import build_index, search
from roisight.llm.chat_format import format_conversations
from roisight.llm.decontamination import decontaminate
from roisight.llm.ngram_join import jaccard_components
from roisight.llm.packing import pack
from roisight.llm.substring_dedup import remove_repeats

ROWS = [[], [(None, None), (None, None), (1, None)]]


@pytest.mark.parametrize("rows", ROWS, ids=["empty", "nulls"])
def test_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int").withColumn("quality", F.lit(None).cast("int"))
    n = len(rows)
    assert [r["n_words"] for r in decontaminate(docs, bench).collect()] == [0] * n
    assert [r["n_shingles"] for r in jaccard_components(docs).collect()] == [0] * n
    assert [r["n_removed"] for r in remove_repeats(docs).collect()] == [0] * n
    assert [r["spans"] for r in secrets.scan_secrets(docs).collect()] == [[]] * n
    assert [r["spans"] for r in pii.find_pii(docs).collect()] == [[]] * n
    assert [r["doc_tokens"] for r in pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()] == [1] * n
    model = toxicity.fit(docs, labels, keep=F.lit(True))
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, model).collect())
    described = quality.describe(docs)
    rules = quality.fit(docs, labels, keep=F.lit(True))
    assert all(r["p"] < 0.01 for r in described.select(quality.compile_rules(rules).alias("p")).collect())


def test_other_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(build_index(vectors), vectors).count() == 0
    nulls = spark.createDataFrame([(None, None)], "vec_id long, embedding array<float>")
    assert search(build_index(nulls), nulls).count() == 0
    turns = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    row = format_conversations(turns).first()
    assert row["round_trip"] and [(t["role"], t["text"]) for t in row["turns"]] == [("", "")]
