"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on labelled rows; every path from a root becomes a
conjunctive rule over statistics; a logistic regression with an L1 penalty keeps
few of the rules; these compile into one Spark column expression.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those of smallest id hash, on
the driver (a dozen numbers each).  Statistics and scores cover all rows and
whole texts, of any length.  Defined cases: a null or empty text has zero
statistics; an empty table gives no rows; without labels every score is 0; with
one class only, its label; repeated rows are scored each; rows that repeat an id
train by their least statistics; labels that repeat an id count once, the larger
one; of cuts of equal gain the first statistic's smallest is taken; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roisight.llm._text import LOWER, NON_SPACE, text_chunks, word_hashes, word_spans
from roisight.llm.toxicity import training_labels

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, CUTS = 40, 3, 0.3, 24
PENALTY = 2e-3

STATISTICS = (
    "n_words", "mean_length", "long_words", "distinct", "repeat_next", "top_word", "upper", "digits", "punctuation",
    "symbols", "bars", "exclaim", "symbol_ends", "lines", "repeated_lines", "letters", "short_lines",
)


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER = _bytes(bytes(range(0x41, 0x5B)))
_LETTER = _UPPER | _bytes(bytes(range(0x61, 0x7B))) | (np.arange(256) >= 0x80)
_DIGIT = _bytes(b"0123456789")
_PUNCTUATION = _bytes(b".,;:!?'\"()-")
_SYMBOL = _bytes(b"#$%&*+/<=>@[\\]^_`{|}~")
_NOT_NEWLINE = ~_bytes(b"\n")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a chunk, by array operations."""
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    words = np.diff(first)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    length = ends - starts
    per = lambda values: np.bincount(doc, values, n)
    low = LOWER[data]
    keys = word_hashes(low, starts, ends)
    order = np.lexsort((keys, doc))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.flatnonzero(fresh)
    count = np.diff(np.append(group, len(keys)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][group], count)
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    l_starts, l_ends, l_first = word_spans(data, offsets, _NOT_NEWLINE)
    lines = np.diff(l_first)
    l_doc = np.repeat(np.arange(n), lines)
    l_keys = word_hashes(data, l_starts, l_ends)
    pairs = np.unique(np.stack([l_doc.astype(np.uint64), l_keys], 1), axis=0) if len(l_keys) else np.zeros((0, 2), np.uint64)
    l_distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=n)
    return np.stack([
        words, per(length) / some, per(length > 12) / some, per(np.zeros(0) if not len(keys) else _spread(fresh, order)) / some, per(again) / some, top / some,
        sums(_UPPER[data]) / sizes, sums(_DIGIT[data]) / sizes, sums(_PUNCTUATION[data]) / sizes, sums(_SYMBOL[data]) / sizes, sums(data == 0x7C) / sizes,
        sums(data == 0x21) / some, per(_SYMBOL[last]) / some, lines, (lines - l_distinct) / np.maximum(lines, 1), sums(_LETTER[data]) / sizes,
        np.bincount(l_doc, (l_ends - l_starts) < 20, n) / np.maximum(lines, 1),
    ], 1)


def _spread(fresh: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order))
    out[order] = fresh
    return out


_OUT = pa.schema([("doc_id", pa.int64()), *((s, pa.float64()) for s in STATISTICS)])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(data, offsets) for _, _, data, offsets in text_chunks(batch.column(1))]
        table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(len(STATISTICS)))], schema=_OUT)


def describe(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The statistics of every document."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_describe, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A condition: statistic, whether it must exceed the cut, the cut.
Rule = tuple[tuple[int, bool, float], ...]


class RuleModel(NamedTuple):
    rules: list[tuple[Rule, float]]
    intercept: float


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of gradient-boosted trees of depth ``DEPTH``; cuts lie at quantiles."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    above = [(x[:, k][:, None] > c[None, :]).astype(float) for k, c in enumerate(cuts)]
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-6

        def split(inside: np.ndarray, path: Rule) -> None:
            if path:
                rules.setdefault(tuple(sorted(path)), None)
            g, h = grad * inside, hess * inside
            best, choice = 1e-3, None
            if len(path) < DEPTH:
                for k, flags in enumerate(above):
                    if not flags.shape[1]:
                        continue
                    gr, hr, nr = g @ flags, h @ flags, inside @ flags
                    gl, hl, nl = g.sum() - gr, h.sum() - hr, inside.sum() - nr
                    gain = gr**2 / (hr + 1) + gl**2 / (hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(nr < 10) | (nl < 10)] = 0
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, choice = gain[at], (k, at)
            if choice is None:
                margin[inside > 0] += RATE * g.sum() / (h.sum() + 1)
                return
            k, at = choice
            right = inside * above[k][:, at]
            split(right, (*path, (k, True, float(cuts[k][at]))))
            split(inside - right, (*path, (k, False, float(cuts[k][at]))))

        split(np.ones(len(y)), ())
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on mean log-loss plus penalty times the L1 norm; the intercept is free."""
    z1 = np.concatenate([z, np.ones((len(z), 1))], 1)
    step = 4.0 * len(z) / max(np.linalg.norm(z1, 2) ** 2, 1e-9)
    w = v = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z1 @ v, -30, 30)))
        u = v - step * (z1.T @ (p - y)) / len(y)
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        w, t = u, t2
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, *, keep: Column, label="quality", id_col="doc_id", text_col="text", train_rows: int = TRAIN_ROWS) -> RuleModel:
    """Rules and weights from training rows (where ``keep`` holds); only their texts are described."""
    spark = documents.sparkSession
    known = spark.createDataFrame([(r[0], r[1]) for r in training_labels(labels, label, keep, train_rows, id_col).collect()], "doc_id long, label int")
    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    one = describe(own).groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("x"))
    rows = one.join(F.broadcast(known), "doc_id").orderBy("doc_id").select("x.*", "label").collect()
    if not rows:
        return RuleModel([], -30.0)
    x = np.array([[r[s] for s in STATISTICS] for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    if y.min() == y.max():
        return RuleModel([], 30.0 if y[0] else -30.0)
    rules = grow_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], 1).astype(float)
    weights, intercept = lasso_logistic(z, y)
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], intercept)


def compile_rules(model: RuleModel) -> Column:
    """The probability of label 1 as a column expression over the statistics."""
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        held = F.lit(True)
        for k, above, cut in rule:
            held &= (F.col(STATISTICS[k]) > cut) if above else (F.col(STATISTICS[k]) <= cut)
        total += F.when(held, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))
