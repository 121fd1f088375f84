"""The stages in turn on a small folder, each against what it may keep."""

import os

import pyarrow.parquet as pq

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.collect()})
        assert kept[-1] <= kept[-2] and len(kept[-1]) > 0.5 * len(kept[-2]), name
    masked = {r["doc_id"]: r for r in docs.collect()}
    assert kept[-1] == kept[-2]
    assert all("@mail" not in r["text"] and (r["text"] == texts[k] or r["n_chars"] == len(r["text"])) for k, r in masked.items())
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == kept[-1]


def test_near_copies_keep_one(spark):
    rows = [(5, "a b c d e f g h", "en", "s", 1), (5, "a b c d e f g h", "en", "s", 1), (3, "a b c d e f g h", "en", "s", 1), (9, "other words", "en", "s", 1), (9, "other words", "en", "s", 1), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()) == ["3", "9", "None"]


def test_near_copies_of_repeated_ids(spark):
    """An id's other text stays when one is a copy, unrelated texts of an id both stay, and the least of equal rows is taken."""
    one, two, three = "a b c d e f g h", "other words stand here in this text", "nothing that any of the others says"
    rows = [(3, one, "en", "s", 1), (5, one, "en", "s", 1), (5, two, "en", "s", 1), (6, two, "en", "s", 1), (7, two, "en", "s", 1), (7, three, "fr", "t", 1), (7, three, "en", "t", 1), (8, None, "en", "s", 0), (None, one, "en", "s", 1)]
    want = [(3, one, "en"), (5, two, "en"), (7, three, "en"), (8, None, "en"), (None, one, "en")]
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        got = corpus_pipeline.drop_near_copies(spark, docs, SMALL).select("doc_id", "text", "lang").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_run_and_registration(spark):
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(oracle_sql()) <= set(names)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and os.path.exists(SMALL) and len({r["doc_id"] for r in rows}) <= pq.read_table(f"{SMALL}/documents.parquet").num_rows
