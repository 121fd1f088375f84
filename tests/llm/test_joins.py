"""Operators that compare documents or vectors, against brute force, with the defined odd cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from roisight.llm import ann, ngram_join, substring_dedup
from roisight.llm.ann import build_index, search
from roisight.llm.components import components
from roisight.llm.ngram_join import jaccard_components
from roisight.llm.substring_dedup import remove_repeats


def near_copies(seed, groups=12, per=14, size=60):
    """Groups of edited copies, a passage that many texts share, exact copies, and odd texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(18))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(3, size))]
        for _ in range(per):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
        texts += [f"{passage} {' '.join(word() for _ in range(30))}" for _ in range(6)]
    rng.shuffle(texts)
    return [*texts, texts[0], None, "", " \n", "one", "ONE", "a b c", "a b c d", "x " * 9000]


def brute_components(rows, width=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(s and t and den * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def as_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, rep long")


@pytest.mark.parametrize("rare,blocks", [(64, None), (2, 3)])
def test_jaccard_components(spark, monkeypatch, rare, blocks):
    if blocks:  # tiny limits send groups through combinations, forests and blocks
        for name, value in (("BLOCK_DOCUMENTS", blocks), ("BLOCK_SHINGLES", 150), ("SMALL_GROUP", 2), ("PIECE_POSTINGS", 200)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = [*enumerate(near_copies(rare)), (3, "another text under an id that repeats"), (None, "no id at all here")]
    got = jaccard_components(as_table(spark, rows), rare=rare).collect()
    want, sets = brute_components([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert jaccard_components(as_table(spark, [])).count() == 0


@pytest.mark.parametrize("small", [False, True], ids=["one block", "many blocks"])
def test_jaccard_hot_groups(spark, monkeypatch, small):
    """A group far beyond a block: a chain of edits, copies of one text, a passage that unlike texts share; and few rows are told."""
    if small:
        for name, value in (("BLOCK_DOCUMENTS", 20), ("BLOCK_SHINGLES", 2_000), ("HOT_CLASS", 5)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(9000)}"
    base = [word() for _ in range(80)]
    texts, chain = [], list(base)
    for k in range(150):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
        chain[(k * 7) % 80] = word()  # each is near the last, few near the first
        texts += [" ".join(chain)] * (k % 2 + 1)
        texts.append(" ".join(base[:25] + [word() for _ in range(30)]))
    rows = [*enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(as_table(spark, rows)).collect()}
    assert got == brute_components(rows)[0]


def test_jaccard_repeated_id(spark):
    """All texts of one id link through it."""
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join(b[:-1])), (12, "else")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(as_table(spark, rows)).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 12: 12}


def test_a_task_tells_a_forest():
    """However many groups hold the same documents, a task tells at most one edge fewer than documents."""
    t, rng = ngram_join.Threshold(85, 100), np.random.default_rng(2)
    tokens = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    n, groups = 40, 50
    bits = [ngram_join.parity_bitmap(np.append(tokens, np.uint64(k)), 1).tobytes() for k in range(n)]
    ids = np.tile(np.arange(n), groups)
    columns = [np.repeat(np.arange(groups), n), ids * 0, ids * 0, ids, ids, ids * 0 + 101]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(bits * groups)], names=["key", "i", "j", "doc", "comp", "n", "bits"])
    told = [r for b in ngram_join._likely_edges(t)([batch]) for r in b.to_pylist()]
    assert len(told) == n - 1


def test_components(spark):
    rng = random.Random(9)
    edges = [(a, a + 1) for a in range(40)] + [(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(60)] + [(7, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def brute_dedup(rows, width=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), i), i)
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("piece", [10**6, 50])
def test_substring_dedup(spark, monkeypatch, piece):
    monkeypatch.setattr(substring_dedup, "PIECE_WINDOWS", piece)
    rows = [*enumerate(near_copies(5)), (2, "the same id again " * 8), (None, " ".join(f"w{k}" for k in range(20))), (900, " ".join(f"w{k}" for k in range(20)))]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(as_table(spark, rows)).collect()), key=repr)
    assert got == sorted(brute_dedup(rows), key=repr)
    assert remove_repeats(as_table(spark, [])).count() == 0


def test_equal_hashes_of_unlike_windows(monkeypatch):
    """With a main hash of six bits, the other bits still tell windows apart."""
    whole = substring_dedup.window_hashes
    monkeypatch.setattr(substring_dedup, "check_hashes", lambda words, width: (whole(words, width) >> np.uint64(8)).astype(np.uint32))
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda words, width: whole(words, width) & np.uint64(63))
    rows = [(i, t) for i, t in enumerate(near_copies(7, 4, 6)) if t]
    found = {}
    for piece in (10**6, 60):
        monkeypatch.setattr(substring_dedup, "PIECE_WINDOWS", piece)
        batches = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "tag": pa.array([0] * len(rows), pa.int32()), "text": [t for _, t in rows]})]
        table = pa.Table.from_batches(list(substring_dedup.entries_by_range(1, 13)(batches)))
        starts = {}
        for r in substring_dedup.repeated_starts(table).to_pylist():
            starts.setdefault(r["doc_id"], set()).update(np.frombuffer(r["starts"], np.uint32).tolist())
        found[piece] = {i: len({p + k for p in s for k in range(13)}) for i, s in starts.items()}
    want = {i: gone for i, _, gone, _ in brute_dedup(rows) if gone}
    assert found[10**6] == want and found[60] == want


def test_nearest(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 16)).astype(np.float32)
    base[100:160] = base[5]  # many equal vectors
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 15), (None, [1.0] * 16), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = build_index(table).persist()
    v = base.astype(float)
    asked = list(range(0, 700, 50)) + [105]
    queries = table.where(table.vec_id.isin(*asked, 1001, 1002))

    def found(factor):
        out = {}
        for r in search(index, queries, 5, factor).collect():
            out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        return out

    exact, hits = found(1.0), 0
    relaxed = found(1.6)
    assert set(exact) == set(asked)
    for q in asked:
        score = (v * v[q]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[q] * v[q]).sum()))
        best = sorted((k for k in range(700) if k != q), key=lambda k: (-score[k], k))[:5]
        assert [exact[q][r][0] for r in range(1, 6)] == best
        assert np.allclose([exact[q][r][1] for r in range(1, 6)], score[best], atol=1e-14)
        hits += len({x[0] for x in relaxed.get(q, {}).values()} & set(best))
    assert hits >= 0.9 * 5 * len(asked)
    assert len(found(1.0)[105]) == 5
    few = search(build_index(table.where("vec_id < 3")), table.where("vec_id = 0"), 5).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_nearest_in_shards_and_blocks(spark, monkeypatch):
    """Several lengths, shards and blocks, repeated ids, and columns with the operator's own names."""
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8 if k % 3 else 5).tolist(), 1, "x") for k in range(300)] + [(7, rng.normal(size=8).tolist(), 2, "y")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, dim string")
    got = {}
    for r in search(build_index(table), table.where("vec_id % 10 = 0"), 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, v, *_ in rows[:300:10]:
        v = np.array(v)
        far = sorted((-float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), k) for k, w, *_ in rows if k != q and len(w) == len(v))
        assert [k for _, k in sorted(got[q])] == [k for _, k in far[:4]]
