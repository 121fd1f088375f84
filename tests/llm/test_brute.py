"""Fitted operators and the pipeline's stages against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_joins import brute_components
from test_rows import DOCS, PII, documents, labelled

import corpus_pipeline
from roisight.llm import quality, toxicity


def plain_tokens(word):
    return {f"={word}", *(f"{word[:k]}*" for k in (3, 4, 5, 6, 7) if len(word) > k)}


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[A-Za-z\x80-\U0010ffff]+", lower)


def test_toxicity_by_strings(spark):
    """Weights, decay, calibration and scores from sets of strings and the definitions."""

    def make(label, rng, words):
        for _ in range(rng.randint(1, 3) * label):
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "Badstemé", "badstem" + rng.choice("abcdef")]))
        return " ".join(words)

    texts, labels = labelled(spark, make, 300)
    texts += [texts[0], None, "", "unlabelled vileword " * 3]
    labels += [(300, 1 - labels[0][1])]  # a copy with another label: the smaller id counts
    docs = documents(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), keep=F.lit(True))
    train = {}
    for k, y in labels:
        train.setdefault(texts[k], (k, y))
    sets = {k: set().union(*map(plain_tokens, plain_words(t))) for k, t in enumerate(texts) if t}
    by = [Counter(w for k, y in train.values() if y == label for w in sets[k]) for label in (0, 1)]
    n = [sum(y == label for _, y in train.values()) for label in (0, 1)]
    total, n_all = Counter(w for s in sets.values() for w in s), len(texts)
    weights = {}
    for w, a in by[1].items():
        if a >= 3 and a * n[0] > by[0][w] * n[1]:
            prior = 60.0 * (total[w] + 0.5) / (n_all + 1)
            p, q = a + prior, by[0][w] + prior
            weight = math.log(p / (n[1] + 60 - p)) - math.log(q / (n[0] + 60 - q)) - 1.64 * math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
            if weight >= 1:
                weights[w] = weight
    assert np.allclose(sorted(model.weights), sorted(weights.values()))
    histogram = Counter()
    for w, x in weights.items():
        histogram[round(x, 1)] += by[0][w] / n[0] * n_all
    top = max(weights.values())
    histogram[top] = max(1.0, histogram.get(round(top, 1), 0.0))
    histogram[-0.08] += sum(len(plain_words(t)) for t in texts)
    mean = sum(c * math.exp(model.decay * s) for s, c in histogram.items()) / sum(histogram.values())
    assert model.decay == 50.0 or abs(mean - 1) < 1e-6

    def proof(text):
        words = plain_words(text)
        scores = [max((weights.get(t, 0.0) for t in plain_tokens(w)), default=0.0) for w in words]
        hot = [k for k, s in enumerate(scores) if s > 0]
        found = sorted((s.score for s in toxicity.maximal_segments(hot, [scores[k] for k in hot], -0.08)), reverse=True) or [0.0]
        ones = [model.decay * s - math.log(max(len(words), 1)) for s in found]
        r = 1 + sum(x > math.log(10) for x in ones[1:])
        tails = [sum(ones[:k]) - (k - 1) * math.log(max(sum(ones[:k]), 1e-300)) + math.log(math.factorial(k) * math.factorial(k - 1)) - k * math.log(2) if k > 1 else ones[0] - math.log(2) for k in range(1, r + 1)]
        return max(tails) / math.log(10)

    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for k, t in enumerate(texts):
        assert rows[k]["evidence"] == pytest.approx(proof(t)) and rows[k]["score"] == pytest.approx(1 / (1 + math.exp(-(model.offset + model.slope * proof(t)))))
    x = np.array([proof(texts[k]) for k, _ in train.values()])
    y = np.array([label for _, label in train.values()])
    p = 1 / (1 + np.exp(-(model.offset + model.slope * x)))
    assert abs((y - p).sum()) < 1e-4 and abs(((y - p) * x).sum() - 1e-2 * model.slope) < 1e-3  # the fit's own optimum


def test_lasso_optimum_and_compiled_rules(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5) | (rng.random(400) < 0.05)).astype(float)
    rules = quality.grow_rules(x, y)
    z = np.stack([quality.holds(r, x) for r in rules], 1).astype(float)
    w, b = quality.lasso_logistic(z, y, 5e-3, 6000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert np.all(np.abs(slope) <= 5e-3 + 1e-4) and np.allclose(slope[w != 0], -5e-3 * np.sign(w[w != 0]), atol=1e-4)
    for rule, row in ((r, z[:, k]) for k, r in enumerate(rules[:40])):
        assert row.tolist() == [float(all((v[k] > cut) == above for k, above, cut in rule)) for v in x]
    model = quality.RuleModel([(r, float(v)) for r, v in zip(rules, w, strict=True) if v], b)
    table = spark.createDataFrame([tuple(map(float, v)) for v in x], list(quality.STATISTICS))
    got = [r["p"] for r in table.select(quality.compile_rules(model).alias("p")).collect()]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-(z @ w + b)))))


def plain_decontaminated(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[a : a + 13]) for w in map(words, items) for a in range(max(len(w) - 13, 0) + 1 if w else 0)}
    kept = set()
    for k, t in texts:
        w = words(t)
        hit = {p for n in {len(x) for x in windows} for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for p in range(a, a + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(k)
    return kept


def plain_masked(text):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p, keep) in enumerate(PII) for m in p.finditer(text or "") if keep(m))
    out, at = [], 0
    for a, _, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def test_stages(spark):
    """Each stage's decisions on all that its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, keep=toxicity.fold("doc_id", 5) != 0)
    clean = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.5}
    kept = corpus_pipeline.drop_toxic(spark, docs, sf).persist()
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns
    component, _ = brute_components([(k, rows[k]["text"]) for k in clean], 5, 4, 5)
    single = corpus_pipeline.drop_near_copies(spark, kept, sf).persist()
    want = {k for k in clean if component[k] == k}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"] is not None]
    apart = corpus_pipeline.drop_contaminated(spark, single, sf).persist()
    want = plain_decontaminated([(k, rows[k]["text"]) for k in want], items)
    assert {r["doc_id"] for r in apart.collect()} == want and apart.columns == docs.columns
    masked = corpus_pipeline.mask_personal_data(spark, apart, sf).collect()
    assert {r["doc_id"]: r["text"] for r in masked} == {k: plain_masked(rows[k]["text"]) for k in want}
    assert all(r["n_chars"] == (rows[r["doc_id"]]["n_chars"] if r["text"] == rows[r["doc_id"]]["text"] else len(r["text"])) for r in masked)


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls, repeated rows, and extra columns with names that the stages use."""
    sf = "/root/testdata/sf0.001"
    copy = " ".join(f"w{k}" for k in range(60))
    for rows in ([], [(1, copy, "en", "s", "r"), (1, copy, "en", "s", "r"), (2, copy + " x", "en", "s", "r"), (None, copy, "en", "s", "r"), (3, None, "en", "s", "r"), (4, "mail a@b.org now", "en", "s", "r")]):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf)
            assert got.columns == docs.columns, name
            texts = sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect())
            if name == "ngram_jaccard":
                assert texts == sorted((str(r[0]), str(r[1])) for r in rows[:1] + rows[3:])
            elif name == "pii":
                assert texts == sorted((str(r[0]), str(r[1]).replace("a@b.org", "[EMAIL]")) for r in rows)
            else:
                assert len(texts) == len(rows)
        assert corpus_pipeline.pack_sequences(spark, docs, sf).where("start = 0").count() == len(rows)
