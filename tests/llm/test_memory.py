"""What Arrow operators hold and hand on at once: executors hold it twice, in the JVM and in Python."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from roisight.llm import ngram_join, toxicity
from roisight.llm._text import SLICE_BYTES, slices


def rows(n: int, size: int) -> pa.RecordBatch:
    """Rows (doc_id, row) with the text within the row, as the pipeline carries them."""
    texts = [None if k % 50 == 7 else f"é{k} " + "word " * (size // 5) for k in range(n)]
    row = pa.StructArray.from_arrays([pa.array(texts), pa.array(range(n))], ["text", "n"])
    return pa.RecordBatch.from_arrays([pa.array(range(n)), row], names=["doc_id", "row"])


def test_slices_keep_all_rows():
    whole = rows(3000, 2000)
    for given in ([whole], [whole.slice(0, 0)], [whole.slice(100, 900), whole.slice(0, 0), whole.slice(5, 1)], [rows(3, 5_000_000)], []):
        got = list(slices(iter(given)))
        assert [r for b in got for r in b.to_pylist()] == [r for b in given for r in b.to_pylist()]
        assert all(b.nbytes <= SLICE_BYTES * 1.5 or len(b) == 1 for b in got) and len(got) >= len(given)


def test_carried_rows_leave_in_small_batches():
    whole = rows(5000, 2000)  # as many bytes as a batch of Spark has
    assert whole.nbytes > 4 * SLICE_BYTES
    none = (SimpleNamespace(value=np.zeros(0, np.uint64)), SimpleNamespace(value=np.zeros(0)))
    out = list(toxicity._scan(*none, 1.0, "text")(iter([whole])))
    assert max(b.nbytes for b in out) <= 2 * SLICE_BYTES
    assert [r["row"] for b in out for r in b.to_pylist()] == whole.column("row").to_pylist()


def test_sets_leave_in_small_batches():
    n, words = 2000, 400
    text = pa.array([" ".join(f"w{k}x{j}" for j in range(words)) for k in range(n)])
    zero = pa.array([0] * n)
    whole = pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(range(n)), zero, text], names=["key", "i", "j", "doc", "comp", "text"])
    out = list(ngram_join._sets(4)(iter([whole])))
    assert max(b.nbytes for b in out) <= 2 * SLICE_BYTES
    assert [d for b in out for d in b.column("doc").to_pylist()] == list(range(n)) and all(len(s) == 8 * (words - 3) for b in out for s in b.column("tokens").to_pylist())


@pytest.mark.parametrize("n", [0, 40])
def test_fit_ships_labels_without_python_workers(spark, monkeypatch, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(IF(id % 4 = 0, 'vile nasty words ', 'some plain text '), id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 4 = 0) AS toxic")

    def refused(*_args, **_options):
        raise AssertionError("a list of rows starts Python workers of its own on every executor")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    model = toxicity.fit(docs, labels, keep=F.lit(True))
    assert model.rate == (0.25 if n else 0.0)
