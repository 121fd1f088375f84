"""Toxic passages as maximum-scoring segments over token log-odds.

1. Tokens are words and word beginnings, as 64-bit hashes.  Candidates are those
   that several toxic training documents hold, and relatively more of them than
   of the other training documents.
2. One pass over all documents counts them; the counts of the whole corpus are
   the Dirichlet prior, the training labels the evidence.  A token's weight is
   the lower confidence bound of its log-odds.
3. A word scores the largest weight among its tokens, or ``NEUTRAL``.  A linear
   scan finds all maximal scoring segments of a document.
4. Segments are judged by the extreme-value law.  With the decay that the
   corpus's score distribution implies, a segment's normalised score is minus
   the log of the number of equal ones that chance gives in a text of that
   length.  All significant segments of a document count together, by the sum
   statistic of its r best, with r chosen at the price of a factor two each.  A
   logistic curve fitted on the training rows turns it into a probability.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those of smallest id hash;
all else covers all rows.

Defined cases: a null or empty text scores like a text without any segment;
without training rows of both classes every score is the rate of label 1 (0
without any); an empty table gives no rows; rows that repeat an id are scored
each, and train by the text of smallest hash; copies of one text train once, by
the smallest id; labels that repeat an id count once, the larger one; equal
segments are listed each; texts of any length are scanned whole; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roisight.llm._store import checkpointed
from roisight.llm._text import LOWER, lean, mix64, text_chunks, word_hashes, word_spans

TRAIN_ROWS = 12_000
LEAST_DOCUMENTS = 3
#: Documents that the prior weighs as much as.
PRIOR_DOCUMENTS = 60.0
CONFIDENCE = 1.64
LEAST_WEIGHT = 1.0
NEUTRAL = -0.08
#: A word's beginnings of these lengths (in characters) are tokens as well.
STEMS = (3, 4, 5, 6, 7)
#: Normalised score of a significant segment: chance gives a tenth of one in such a text.
SIGNIFICANT = math.log(10)
#: Tokens that a task holds before it passes their counts on.
HELD_TOKENS = 1_000_000

#: Letters: ASCII ones and all non-ASCII bytes.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True


def token_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row for each word of lower-cased bytes: its own token, then its longer beginnings; 0 where it has none."""
    points = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))
    first = np.searchsorted(points, starts)
    size = np.searchsorted(points, ends) - first
    out = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    out[:, 0] = mix64(word_hashes(low, starts, ends) ^ np.uint64(0x2545F4914F6CDD1D))
    for k, length in enumerate(STEMS):
        some = np.flatnonzero(size > length)
        out[some, k + 1] = word_hashes(low, starts[some], points[first[some] + length])
    return out


class Words(NamedTuple):
    """The words of a chunk: where they are, each one's place among the distinct ones, and these ones' tokens."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    which: np.ndarray
    tokens: np.ndarray


def chunk_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, LETTERS)
    _, where, which = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(where)  # in the order of the text
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return Words(starts, ends, first, place[which], token_hashes(low, starts[where[order]], ends[where[order]]))


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(keys.shape, -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def distinct_tokens(words: Words, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, value) once each, for values by distinct word and token; negative ones are left out."""
    docs = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    use = (values >= 0).any(1)[words.which]
    pairs = np.unique(docs[use] * len(values) + words.which[use])
    doc, held = pairs // max(len(values), 1), values[pairs % max(len(values), 1)]
    doc, held = np.repeat(doc, held.shape[1]), held.ravel()
    doc, held = doc[held >= 0], held[held >= 0]
    order = np.lexsort((held, doc))
    doc, held = doc[order], held[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (held[1:] != held[:-1])
    return doc[fresh], held[fresh]


class Segment(NamedTuple):
    start: int
    end: int
    score: float


def maximal_segments(positions: list[int], scores: list[float], neutral: float) -> list[Segment]:
    """All maximal scoring segments of a sequence that scores ``neutral`` but at these positions.

    Linear time: each candidate keeps the sum before it and up to its end; a
    new one joins earlier ones while that yields a larger total.
    """
    left: list[float] = []
    right: list[float] = []
    spans: list[tuple[int, int]] = []
    before = 0  # index of the nearest candidate to the left with a smaller left sum, for each
    links: list[int] = []
    total, last = 0.0, 0
    for at, score in zip(positions, scores, strict=True):
        total += neutral * (at - last)
        last = at + 1
        l, total, start = total, total + score, at
        r = total
        while True:
            before = len(left) - 1
            while before >= 0 and left[before] >= l:
                before = links[before]
            if before < 0 or right[before] >= r:
                break
            l, start = left[before], spans[before][0]
            del left[before:], right[before:], spans[before:], links[before:]
        left.append(l), right.append(r), spans.append((start, at + 1)), links.append(before)
    return [Segment(a, b, r - l) for l, r, (a, b) in zip(left, right, spans, strict=True)]


class Model(NamedTuple):
    tokens: np.ndarray  # sorted
    weights: np.ndarray
    decay: float
    offset: float
    slope: float
    rate: float


def chance_decay(histogram: dict[float, float]) -> float:
    """The positive root of sum p(s) exp(x s) = 1, by bisection; scores have a negative mean."""
    total = sum(histogram.values())
    grow = lambda x: sum(n / total * math.exp(min(x * s, 700.0)) for s, n in histogram.items()) - 1
    low, high = 1e-6, 50.0
    if grow(high) < 0:
        return high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 0 else (low, mid)
    return low


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-9, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def normalised(score: float, words: int, decay: float) -> float:
    """Minus the log of the number of segments that score as much by chance in a text of so many words."""
    return decay * score - math.log(max(words, 1))


def evidence(scores: list[float], words: int, decay: float) -> float:
    """Minus log10 of the chance of a document's best segments together.

    The sum t of the r best normalised scores has a tail near exp(-t) t**(r-1) / (r! (r-1)!);
    r runs over one and the significant ones, each at the price of a factor two.
    """
    best, total = -math.inf, 0.0
    for r, score in enumerate(sorted(scores, reverse=True) or [0.0], 1):
        one = normalised(score, words, decay)
        if r > 1 and one <= SIGNIFICANT:
            break
        total += one
        more = (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) if r > 1 else 0.0
        best = max(best, total - more - r * math.log(2))
    return best / math.log(10)


def fold(id_col: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts))


def training_labels(labels: DataFrame, label: str, keep: Column, rows: int, id_col="doc_id") -> DataFrame:
    """At most ``rows`` labelled ids of smallest hash: a bounded sample, small enough to broadcast."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & keep)
    one = clean.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


@lean
def _count_training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, toxic, other): documents that hold a token, from rows (label, text)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in held] or [np.zeros(0, np.int64)])
        toxic = np.concatenate([t for _, t in held] or [np.zeros(0, bool)])
        names, which = np.unique(keys, return_inverse=True)
        number = np.bincount(which, minlength=len(names))
        hits = np.bincount(which, toxic, len(names)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(hits), pa.array(number - hits)], names=["token", "toxic", "other"])

    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in text_chunks(batch.column(1)):
            words = chunk_words(data, offsets)
            names, place = np.unique(words.tokens, return_inverse=True)
            doc, at = distinct_tokens(words, np.where(words.tokens > 0, place.reshape(words.tokens.shape), -1))
            held.append((names.view(np.int64)[at], labels[lo + doc] == 1))
            if sum(len(k) for k, _ in held) > HELD_TOKENS:
                yield counted()
                held.clear()
    yield counted()


def _count_corpus(candidates: Broadcast):
    """Rows (token number, documents); after the last number, documents and then words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = candidates.value
        counts = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                words = chunk_words(data, offsets)
                _, at = distinct_tokens(words, found_in(known, words.tokens))
                counts[:-2] += np.bincount(at, minlength=len(known))
                counts[-2:] += [hi - lo, len(words.starts)]
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["token", "total"])

    return run


def _scan(tokens: Broadcast, weights: Broadcast, decay: float, text_field: str | None = None):
    """Rows (id, words, evidence, passages, other columns): significant segments as (start, end, score) in code points.

    The text is the second column, or a field of it, a struct that is passed on.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = 1 if text_field else 2
        known, value = tokens.value, np.append(weights.value, 0.0)  # the last is what -1 finds
        for batch in batches:
            out_words, out_evidence, out_passages = [], [], []
            text = batch.column(1).field(text_field).cast(pa.string()) if text_field else batch.column(1)
            for lo, hi, data, offsets in text_chunks(text):
                words = chunk_words(data, offsets)
                score = value[found_in(known, words.tokens)].max(1, initial=0.0)[words.which]
                hot = np.flatnonzero(score > 0)
                bounds = np.searchsorted(hot, words.first)
                sizes = np.diff(words.first)
                chars = None
                for k in range(hi - lo):
                    n, at = int(sizes[k]), hot[bounds[k] : bounds[k + 1]]
                    segments = maximal_segments((at - words.first[k]).tolist(), score[at].tolist(), NEUTRAL) if len(at) else []
                    out_words.append(n)
                    out_evidence.append(evidence([s.score for s in segments], n, decay))
                    told = [s for s in segments if normalised(s.score, n, decay) > SIGNIFICANT]
                    if told and chars is None:
                        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    base = int(words.first[k])
                    place = lambda byte: int(chars[byte] - chars[offsets[k]])  # noqa: B023, E731
                    out_passages.append([{"start": place(words.starts[base + s.start]), "end": place(words.ends[base + s.end - 1]), "score": s.score} for s in told])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_words, pa.int64()), pa.array(out_evidence, pa.float64()), pa.array(out_passages, _SEGMENTS), *batch.columns[skip:]], names=["doc_id", "n_words", "evidence", "passages", *batch.schema.names[skip:]])

    return run


_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SCANNED = "doc_id long, n_words long, evidence double, passages array<struct<start:long,end:long,score:double>>"


def fit(documents: DataFrame, labels: DataFrame, *, keep: Column, label="toxic", id_col="doc_id", text_col="text", train_rows: int = TRAIN_ROWS) -> Model:
    """Weights and calibration from training rows (where ``keep`` holds) and counts of all documents."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    # as an Arrow table these rows are local ones, a list of tuples would start Python workers
    known = spark.createDataFrame(training_labels(labels, label, keep, train_rows).toArrow())
    own = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("print"), "label", "text")).alias("r"))
    once = own.groupBy("r.print").agg(F.min(F.struct("doc_id", "r.label", "r.text")).alias("r"))  # copies of one text are evidence once
    train = checkpointed(once.select("r.*"))
    number = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    n_toxic, n_other = number.get(1, 0), number.get(0, 0)
    rate = n_toxic / (n_toxic + n_other) if n_toxic + n_other else 0.0
    if not n_toxic or not n_other:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0.0, rate)
    seen = train.select("label", "text").mapInArrow(_count_training, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    chosen = seen.where((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("toxic") * n_other > F.col("other") * n_toxic)).collect()
    table = np.array([tuple(r) for r in chosen], np.int64).reshape(-1, 3)
    table = table[np.argsort(table[:, 0].view(np.uint64))]
    tokens, toxic, other = table[:, 0].view(np.uint64).copy(), table[:, 1], table[:, 2]
    counted = docs.select("text").mapInArrow(_count_corpus(spark.sparkContext.broadcast(tokens)), "token long, total long")
    total = np.zeros(len(tokens) + 2)
    for r in counted.groupBy("token").agg(F.sum("total")).collect():
        total[r[0]] = r[1]
    weights = token_weights(toxic, other, total[:-2], n_toxic, n_other, total[-2])
    use = weights >= LEAST_WEIGHT
    tokens, weights = tokens[use], weights[use]
    decay = chance_decay(score_histogram(weights, other[use] / n_other * total[-2], total[-1]))
    cast = spark.sparkContext.broadcast
    scanned = train.select("doc_id", "text", "label").mapInArrow(_scan(cast(tokens), cast(weights), decay), SCANNED + ", label int")
    rows = scanned.select("doc_id", "evidence", "label").orderBy("doc_id").collect()
    offset, slope = fit_logistic(np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows]))
    return Model(tokens, weights, decay, offset, slope, rate)


def token_weights(toxic, other, total, n_toxic: int, n_other: int, n_all: float) -> np.ndarray:
    """Lower confidence bounds of the log-odds of tokens, with the corpus's share as Dirichlet prior."""
    prior = PRIOR_DOCUMENTS * (total + 0.5) / (n_all + 1)
    a, b = toxic + prior, other + prior
    odds = np.log(a / (n_toxic + PRIOR_DOCUMENTS - a)) - np.log(b / (n_other + PRIOR_DOCUMENTS - b))
    return odds - CONFIDENCE * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def score_histogram(weights: np.ndarray, uses: np.ndarray, words: float) -> dict[float, float]:
    """How often a word scores what in texts that are not toxic; the largest weight once at least."""
    out: Counter[float] = Counter()
    for w, n in zip(weights.tolist(), uses.tolist(), strict=True):
        out[round(w, 1)] += n
    top = float(weights.max(initial=1.0))
    out[top] = max(1.0, out.get(round(top, 1), 0.0))
    out[NEUTRAL] += max(words, 1.0)
    return out


def score(documents: DataFrame, model: Model, *, id_col="doc_id", text_col="text", carry: bool = False) -> DataFrame:
    """One row per document: words, evidence, probability, and every segment that chance explains less than once in ten texts.

    With ``carry`` the input row comes along in a column ``row``, so that nothing has to be joined back.
    """
    schema = T._parse_datatype_string(SCANNED)
    cast = documents.sparkSession.sparkContext.broadcast
    tokens, weights = cast(model.tokens), cast(model.weights)
    if carry:  # the text travels once, within the row
        rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
        scanned = rows.mapInArrow(_scan(tokens, weights, model.decay, text_col), schema.add("row", documents.schema))
    else:
        rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        scanned = rows.mapInArrow(_scan(tokens, weights, model.decay), schema)
    chance = 1 / (1 + F.exp(-(F.lit(model.offset) + F.lit(model.slope) * F.col("evidence"))))
    return scanned.select("doc_id", "n_words", "evidence", chance.alias("score"), "passages", *(["row"] if carry else []))
