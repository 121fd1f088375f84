"""Exact n-gram Jaccard join by token-combination prefixes, and its components.

Documents are sets of word shingles (64-bit hashes, whose order is the global
token order).  Two sets that reach the threshold share a token among their
first n - ceil(t n) + 1, and ``m`` + 1 tokens among ``m`` more than these.

1. Documents with equal sets form a class; its smallest id stands for it.
2. Extended prefixes are indexed.  A token in at most ``RARE`` of them is a
   signature by itself.  Frequent tokens fall into ``m`` classes, and each pair
   of tokens within a class is a signature; of ``m`` + 1 shared frequent tokens
   two are in one class, so no pair is lost.  ``m`` depends on the size group of
   a set, and sets use that of their own group and the next, which two sets
   that link have in common.
3. Within a signature's group a lossless filter (sizes, parity bitmaps of the
   whole sets) leaves likely pairs.  A first round looks at three signatures of
   each document, groups beyond ``BLOCK_DOCUMENTS`` in blocks that have one
   document in common; this unites most copies.  A second round looks at the
   groups that still hold several components, and only at pairs across them.
   A task tells a pair only if it joins two of the trees that it keeps.
4. Likely pairs form clusters.  A cluster's sets meet in one task (in blocks
   beyond ``BLOCK_SHINGLES``, in the same two rounds), where a search with
   exact intersections keeps a spanning forest of the links.
5. Components of these forests are the components of all links.

No step emits all pairs of a group, and no group has to fit in a task whole.  A
group of copies costs rows in proportion to its size; only documents that share
a frequent signature and do not link are compared block by block.

Defined cases: a null or empty text has no set and links with nothing; with
fewer words than a shingle the whole sequence is one shingle; rows that repeat
an id are one document that has all their links; a null id gives a null
component and takes no part; an empty table gives no rows; a text of any length
is one set; columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roisight.llm._store import checkpointed, maybe_broadcast
from roisight.llm._text import LOWER, NON_SPACE, lean, mix64, text_chunks, window_hashes, word_hashes, word_spans
from roisight.llm.components import components

WIDTH = 4
#: Threshold as a fraction: intersection * DEN >= union * NUM.
NUM, DEN = 85, 100
#: Prefixes that hold a rare token, at most.
RARE = 64
#: Postings that a task looks through for tokens frequent within them.
PIECE_POSTINGS = 1_000_000
#: Groups up to this size are compared pair by pair.
SMALL_GROUP = 16
#: Documents of a signature, and shingles of a cluster, that meet in one block.
BLOCK_DOCUMENTS = 2_000
BLOCK_SHINGLES = 4_000_000
#: Documents that share one set, beyond which it is joined by a broadcast.
HOT_CLASS = 1_000


class Threshold:
    """Prefix sizes and filters for one Jaccard threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.base = 1.02 * den / num

    def least_size(self) -> int:
        """Below it, only equal sets link."""
        return self.den if self.num >= self.den else max(1, -(-self.num // (self.den - self.num)))

    def group(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(n) / math.log(self.base)).astype(np.int64)

    def classes(self, group: np.ndarray) -> np.ndarray:
        """How many classes of frequent tokens a size group uses."""
        return np.maximum(1, np.round(0.25 * (1 - self.num / self.den) * self.base ** np.asarray(group, float))).astype(np.int64)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.num * n // self.den) + 1

    def least_overlap(self, n1, n2):
        return -(-self.num * (n1 + n2) // (self.num + self.den))

    def sizes_fit(self, n1, n2):
        return self.den * np.minimum(n1, n2) >= self.num * np.maximum(n1, n2)

    def linked(self, both, n1, n2):
        return self.den * both >= self.num * (n1 + n2 - both)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, NON_SPACE)
    words = word_hashes(low, starts, ends)
    hashes = window_hashes(words, width)
    out = []
    for k in range(len(offsets) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= width:
            out.append(np.unique(hashes[a : b - width + 1]))
        else:
            out.append(window_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _prints(batches_width):
    width = batches_width

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p1, p2 = [], [], []
            for _, _, data, offsets in text_chunks(batch.column(2)):
                for s in shingle_sets(data, offsets, width):
                    n.append(len(s))
                    p1.append(int(mix64(s + np.uint64(1)).sum(dtype=np.uint64)))
                    p2.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array(np.array(p, np.uint64).view(np.int64)) for p in (p1, p2))], names=["doc_id", "tag", "n", "p1", "p2"]
            )

    return run


def _postings(width: int, t: Threshold, rare: int):
    """Rows (route, token, doc, code, weight): token postings by token; tokens frequent in a piece by document."""

    def emit(kept: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, codes, tokens = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(tokens, kind="stable")
        docs, codes, tokens = docs[order], codes[order], tokens[order].view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(first, len(tokens)))
        hot = np.repeat(count > rare, count)
        told = tokens[first[count > rare]]  # one row says that such a token is frequent
        spread = mix64(docs.view(np.uint64)).view(np.int64)
        route = np.concatenate([np.where(hot, spread, tokens), told])
        weight = np.concatenate([np.where(hot, 0, 1), np.full(len(told), rare + 1)]).astype(np.int32)
        docs = np.concatenate([docs, np.zeros(len(told), np.int64)])
        codes = np.concatenate([codes, np.zeros(len(told), np.int16)])
        tokens = np.concatenate([tokens, told])
        for at in range(0, len(route), 200_000):
            s = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (route, tokens, docs, codes, weight)], names=["route", "token", "doc", "code", "weight"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                for k, s in enumerate(shingle_sets(data, offsets, width)):
                    if len(s) < t.least_size():
                        continue
                    n = np.int64(len(s))
                    group = t.group(n)
                    inner, outer = (min(len(s), int(t.prefix(n) + t.classes(g))) for g in (group, group + 1))
                    code = np.full(outer, 2 * group + 1, np.int16)
                    code[:inner] -= 1
                    kept.append((np.full(outer, ids[lo + k], np.int64), code, s[:outer]))
                    size += outer
                if size >= PIECE_POSTINGS:
                    yield from emit(kept)
                    kept, size = [], 0
        if kept:
            yield from emit(kept)

    return run


def _signatures(t: Threshold):
    """Rows (sig, doc): rare prefix tokens, and pairs of frequent ones within a class for both size groups."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            out_sig, out_doc = [], []
            for k in range(len(docs)):
                held = lists[k].values
                tokens = held.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
                codes = held.field("code").to_numpy(zero_copy_only=False).astype(np.int64)
                often = held.field("frequent").to_numpy(zero_copy_only=False).astype(bool)
                rare = np.unique(tokens[~often])
                out_sig.append(rare), out_doc.append(np.full(len(rare), docs[k], np.int64))
                tokens, codes = tokens[often], codes[often]
                for group in np.unique(codes // 2).tolist():
                    for own in (group, group + 1):
                        use = np.unique(tokens[(codes // 2 == group) & (codes <= 2 * group + (own > group))])
                        kind = (mix64(use) % np.uint64(t.classes(own))).astype(np.int64)
                        order = np.lexsort((use, kind))
                        use, kind = use[order], kind[order]
                        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else []
                        for a, b in zip(first, np.append(first[1:], len(kind)) if len(kind) else [], strict=True):
                            if b - a > 1:
                                i, j = np.triu_indices(b - a, 1)
                                sig = mix64(use[a:b][i] * np.uint64(3) + mix64(use[a:b][j]) + np.uint64(own))
                                out_sig.append(sig), out_doc.append(np.full(len(sig), docs[k], np.int64))
            if out_sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_sig).view(np.int64)), pa.array(np.concatenate(out_doc))], names=["sig", "doc"])

    return run


def bit_class(n: int) -> int:
    """Bitmaps have 2**class words of 64 bits, about a bit for each token."""
    return max(0, math.ceil(math.log2(max(n, 1) / 64)))


def parity_bitmap(tokens: np.ndarray, kind: int) -> np.ndarray:
    """Each token flips one bit; two sets differ in at least as many tokens as their bitmaps in bits."""
    bits = np.bincount((mix64(tokens ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(64 << kind)).astype(np.int64), minlength=64 << kind) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _bitmaps(width: int, t: Threshold):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            docs, sizes, bits = [], [], []
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                for k, s in enumerate(shingle_sets(data, offsets, width)):
                    if len(s) >= t.least_size():
                        docs.append(ids[lo + k]), sizes.append(len(s)), bits.append(parity_bitmap(s, bit_class(len(s))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["doc", "n", "bits"])

    return run


def fold(words: np.ndarray, kind: int) -> np.ndarray:
    """Bitmaps (rows) of more words as ones of 2**kind words: halves meet by exclusive or."""
    while words.shape[1] > 1 << kind:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


class Lot:
    """Rows of whole groups, with bitmaps by class, for vectorised comparison."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], comp: np.ndarray):
        self.ids, self.sizes, self.comp = ids, sizes, comp
        self.kind = np.array([len(b) // 8 for b in bits], np.int64)
        self.kind = np.log2(np.maximum(self.kind, 1)).round().astype(np.int64)
        self.place = np.zeros(len(ids), np.int64)
        self.words = {}
        for kind in np.unique(self.kind).tolist():
            rows = np.flatnonzero(self.kind == kind)
            self.place[rows] = np.arange(len(rows))
            self.words[kind] = np.frombuffer(b"".join(bits[r] for r in rows), np.uint64).reshape(len(rows), -1)

    def likely(self, i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
        """Which pairs of rows may link; none that links is left out."""
        n1, n2 = self.sizes[i], self.sizes[j]
        out = t.sizes_fit(n1, n2) & (self.comp[i] != self.comp[j])
        at = np.flatnonzero(out)
        room = (n1 + n2 - 2 * t.least_overlap(n1, n2))[at]
        k1, k2 = self.kind[i[at]], self.kind[j[at]]
        for a, b in {*zip(k1.tolist(), k2.tolist(), strict=True)}:
            some = np.flatnonzero((k1 == a) & (k2 == b))
            low = min(a, b)
            for lo in range(0, len(some), 65_536):
                s = some[lo : lo + 65_536]
                x = fold(self.words[a][self.place[i[at[s]]]], low)
                y = fold(self.words[b][self.place[j[at[s]]]], low)
                out[at[s]] = np.bitwise_count(x ^ y).sum(1) <= room[s]
        return out

    def pairs(self, rows: np.ndarray, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Likely pairs within each group of a matrix (groups x members)."""
        a, b = np.triu_indices(rows.shape[1], 1)
        step = max(1, 500_000 // len(a))
        for lo in range(0, len(rows), step):
            i, j = rows[lo : lo + step][:, a].ravel(), rows[lo : lo + step][:, b].ravel()
            ok = self.likely(i, j, t)
            yield i[ok], j[ok]

    def forest(self, rows: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
        """Spanning forest of the likely pairs within one group."""
        waiting, edges = rows, []
        while len(waiting):
            queue, waiting = [int(waiting[0])], waiting[1:]
            while queue and len(waiting):
                at = queue.pop()
                ok = self.likely(np.full(len(waiting), at), waiting, t)
                edges += [(at, int(r)) for r in waiting[ok]]
                ok |= self.comp[waiting] == self.comp[at]
                queue += waiting[ok].tolist()
                waiting = waiting[~ok]
        return edges


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows that end where the leading key columns change; input is sorted by them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1].as_py() for k in range(keys)]
        same = np.ones(len(table), bool)
        for k, v in enumerate(last):
            same &= table.column(k).to_numpy() == v
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size = len(table) - cut
    if held:
        yield pa.Table.from_batches(held)


def _group_bounds(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for k in range(keys):
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(table))


class Trees:
    """Disjoint sets of a task's nodes: which edges join two of them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def _root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self._root(a), self._root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _likely_edges(t: Threshold):
    """Rows (a, b) of likely pairs from rows (key, i, j, doc, comp, n, bits) sorted by the first three.

    Pairs within a component (``comp``) are not looked at, and a pair is told only
    if it joins two trees that the whole task holds: fewer rows than documents.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees()
        for table in whole_groups(batches, 3, 20_000):
            bounds = _group_bounds(table, 3)
            count = np.diff(bounds)
            comp = table.column(4).to_numpy()
            lot = Lot(table.column(3).to_numpy(), table.column(5).to_numpy(), table.column(6).to_pylist(), comp)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(count[count > 1]).tolist():
                at = bounds[:-1][count == size]
                if size <= SMALL_GROUP:
                    for i, j in lot.pairs(at[:, None] + np.arange(size), t):
                        left.append(i), right.append(j)
                else:
                    for a in at.tolist():
                        edges = lot.forest(np.arange(a, a + size), t)
                        left.append(np.array([e[0] for e in edges], np.int64)), right.append(np.array([e[1] for e in edges], np.int64))
            i, j = np.concatenate(left), np.concatenate(right)
            if len(i):
                told = [x[:2] for x in zip(lot.ids[i].tolist(), lot.ids[j].tolist(), comp[i].tolist(), comp[j].tolist(), strict=True) if trees.joins(x[2], x[3])]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told, strict=True)], names=["a", "b"])

    return run


def _sets(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, data, offsets in text_chunks(batch.column(5)):
                sets += [s.tobytes() for s in shingle_sets(data, offsets, width)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sets, pa.binary())], names=["key", "i", "j", "doc", "comp", "tokens"])

    return run


def exact_forest(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """Spanning forest of the links between sets of different components, by exact intersections."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        if comp[0] == comp[1]:
            return []
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if t.linked(both, sizes[0], sizes[1]) else []
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [flat[bounds[k] : bounds[k + 1]] for k in range(len(sets))]
    mark = np.zeros(len(names), bool)
    waiting, edges = np.arange(len(sets)), []
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            mark[own[at]] = True
            ok = comp[waiting] == comp[at]
            fit = np.flatnonzero(t.sizes_fit(sizes[at], sizes[waiting]) & ~ok)
            some = waiting[fit]
            size = sizes[some]
            where = np.repeat(bounds[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            both = np.add.reduceat(mark[flat[where]].astype(np.int64), np.cumsum(size) - size) if len(some) else np.zeros(0, np.int64)
            mark[own[at]] = False
            near = fit[t.linked(both, sizes[at], size)]
            edges += [(int(ids[at]), int(ids[k])) for k in waiting[near]]
            ok[near] = True
            queue += waiting[ok].tolist()
            waiting = waiting[~ok]
    return edges


def _links(t: Threshold):
    """Rows (a, b) of links from rows (key, i, j, doc, comp, tokens) sorted by the first three."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3, 500):
            bounds = _group_bounds(table, 3)
            ids, comp = table.column(3).to_numpy(), table.column(4).to_numpy()
            tokens = table.column(5)
            edges = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo > 1:
                    edges += exact_forest(ids[lo:hi], comp[lo:hi], [np.frombuffer(tokens[k].as_py(), np.uint64) for k in range(lo, hi)], t)
            if edges:
                pairs = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _own_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(7)), F.col(blocks)).cast("int")


def first_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (key, doc, total) dealt to blocks (key, i, j, doc, comp): a document to one, a key's least document to all of its.

    ``total`` is the weight of a key; a block takes about ``limit`` of it.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("total") / limit).cast("int"))
    own = rows.select("key", _own_block("blocks").alias("i"), "doc")
    pivot = rows.where("blocks > 1").groupBy("key").agg(F.min("doc").alias("doc"), F.max("blocks").alias("blocks"))
    every = pivot.withColumn("own", _own_block("blocks")).select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "doc", "own")
    return own.unionByName(every.where("i <> own").drop("own")).select("key", "i", F.lit(0).alias("j"), "doc", F.col("doc").alias("comp"))


def later_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (key, doc, comp, size) in blocks where any two of a key and of different components meet.

    Keys of one component are left out.  A key beyond ``limit`` has its largest
    component dealt to blocks once for each block of the others, so what a few
    others add to a large group of copies is in proportion to the group.
    """
    held = rows.groupBy("key", "comp").agg(F.sum("size").alias("size"))
    keys = held.groupBy("key").agg(F.count("*").alias("comps"), F.sum("size").alias("total"), F.max(F.struct("size", "comp")).alias("top")).where("comps > 1")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / limit)).cast("int")
    keys = checkpointed(keys.select("key", "total", F.col("top.comp").alias("largest"), blocks(F.col("top.size")).alias("large"), blocks(F.col("total") - F.col("top.size")).alias("others")))
    zero = F.lit(0)
    whole = rows.join(keys.where(F.col("total") <= limit).select("key"), "key").select("key", zero.alias("i"), zero.alias("j"), "doc", "comp")
    wide = keys.where(F.col("total") > limit)
    if wide.isEmpty():
        return whole
    cut = rows.join(wide, "key").withColumn("main", F.col("comp") == F.col("largest"))
    cut = cut.withColumn("own", F.when(F.col("main"), _own_block("large")).otherwise(_own_block("others")))
    once = cut.where("main AND others = 1").select("key", F.col("own").alias("i"), F.lit(-1).alias("j"), "doc", "comp")
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    at = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    main = F.transform(upto("others"), lambda o: at(F.col("own"), -1 - o))
    rest = F.concat(F.transform(upto("large"), lambda b: at(b, -1 - F.col("own"))), F.transform(upto("others"), lambda o: at(F.least(o, "own"), F.greatest(o, "own"))))
    several = cut.where("NOT main OR others > 1").select("key", F.explode(F.when(F.col("main"), main).otherwise(rest)).alias("at"), "doc", "comp")
    return whole.unionByName(once).unionByName(several.select("key", "at.i", "at.j", "doc", "comp"))


def _classes(real: DataFrame, rows: int, least: int) -> DataFrame:
    """Documents (doc_id, tag, n) with the smallest id of an equal set (rep).

    Sets that more than a hundred-thousandth of all rows share (there are at most
    100,000 of them) are joined by a broadcast; a window finds the others' least.
    """
    key = ["n", "p1", "p2"]
    first = real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    often = F.broadcast(checkpointed(first.where(F.col("c") > max(least, rows // 100_000)).drop("c").coalesce(8)))
    columns = ["doc_id", "tag", "n", "rep"]
    seldom = real.join(often.drop("rep"), key, "left_anti").withColumn("rep", F.min("doc_id").over(Window.partitionBy(*key)))
    return real.join(often, key).select(*columns).unionByName(seldom.select(*columns))


def jaccard_components(documents: DataFrame, *, id_col="doc_id", text_col="text", width: int = WIDTH, num: int = NUM, den: int = DEN, rare: int = RARE) -> DataFrame:
    """One row per document: shingles in its set and the smallest id that links reach."""
    t = Threshold(num, den)
    parts = max(2, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("text"))
    prints = checkpointed(docs.mapInArrow(_prints(width), "doc_id long, tag int, n long, p1 long, p2 long"))
    real = prints.where("n > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(_classes(real, real.count(), HOT_CLASS))
    others = classes.where(f"doc_id <> rep OR n < {t.least_size()}").select("doc_id", "tag").distinct()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").join(maybe_broadcast(others, 16), ["doc_id", "tag"], "left_anti").select("doc_id", "text")

    # sums over a window count prefixes in the one exchange that the postings take
    posted = texts.mapInArrow(_postings(width, t, rare), "route long, token long, doc long, code short, weight int")
    counted = posted.withColumn("df", F.sum("weight").over(Window.partitionBy("route")))
    shared = counted.where("weight = 0 OR (weight = 1 AND df >= 2)").select("doc", "token", "code", ((F.col("weight") == 0) | (F.col("df") > rare)).alias("frequent"))
    gathered = shared.groupBy("doc").agg(F.collect_list(F.struct("token", "code", "frequent")).alias("held"))
    signed = checkpointed(gathered.mapInArrow(_signatures(t), "sig long, doc long"))

    # signatures with the same documents are one
    members = signed.groupBy("sig").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.xxhash64("doc", F.lit(1)).bitwiseAND(0x7FFFFFFF)).alias("s"))
    kept = members.where("m >= 2").groupBy("m", "x", "s").agg(F.min("sig").alias("key")).select("key", "m")
    grouped = checkpointed(signed.withColumnRenamed("sig", "key").join(kept, "key"))
    bitmaps = checkpointed(texts.mapInArrow(_bitmaps(width, t), "doc long, n long, bits binary"))

    def near(rows: DataFrame) -> DataFrame:
        met = rows.join(bitmaps, "doc").select("key", "i", "j", "doc", "comp", "n", "bits")
        return met.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_likely_edges(t), "a long, b long")

    # three signatures of each document unite most copies; then the groups that still hold several components
    some = lambda s: F.struct(s["key"].alias("key"), s["m"].alias("total"))
    chosen = grouped.groupBy("doc").agg(*(f(x).alias(n) for n, f, x in (("most", F.max, F.struct("m", "key")), ("low", F.min, F.struct("key", "m")), ("high", F.max, F.struct("key", "m")))))
    chosen = chosen.select("doc", F.explode(F.array_distinct(F.array(*(some(F.col(c)) for c in ("most", "low", "high"))))).alias("s")).select("s.*", "doc")
    clusters = _components_of(grouped.select("key", "doc", F.lit(1).alias("size")), chosen, near, BLOCK_DOCUMENTS)

    sizes = classes.where("doc_id = rep").groupBy(F.col("doc_id").alias("doc")).agg(F.max("n").alias("size"))
    placed = checkpointed(clusters.select(F.col("component").alias("key"), F.col("node").alias("doc")).join(sizes, "doc"))
    volume = placed.groupBy("key").agg(F.sum("size").alias("total"))

    def exact(rows: DataFrame) -> DataFrame:
        met = texts.withColumnRenamed("doc_id", "doc").join(maybe_broadcast(checkpointed(rows), 40), "doc").select("key", "i", "j", "doc", "comp", "text")
        sets = met.mapInArrow(_sets(width), "key long, i int, j int, doc long, comp long, tokens binary")
        return sets.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links(t), "a long, b long")

    held = placed.join(volume, "key")
    reached = _components_of(held.where(F.col("total") > BLOCK_SHINGLES).select("key", "doc", "size"), held.select("key", "doc", "total"), exact, BLOCK_SHINGLES, _same_id(classes))

    by_doc = classes.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    by_doc = by_doc.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", F.col("n").alias("n_shingles")).join(by_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _same_id(classes: DataFrame) -> DataFrame:
    """Edges between the classes of different texts under one id."""
    several = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("far")).where("a < far").select("doc_id", "a")
    return classes.join(several, "doc_id").where("a < rep").select("a", F.col("rep").alias("b"))


def _components_of(rows: DataFrame, first: DataFrame, compare, limit: int, more: DataFrame | None = None) -> DataFrame:
    """Components (node, component) of what ``compare`` finds in blocks: first in those of ``first`` (key, doc, total), then in all of ``rows`` (key, doc, size) that stay apart."""
    edges = checkpointed(compare(first_blocks(first, limit)))
    edges = edges if more is None else checkpointed(edges.unionByName(more))
    found = checkpointed(components(edges))
    apart = rows.join(found.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    later = checkpointed(compare(later_blocks(checkpointed(apart), limit)))
    if later.isEmpty():
        return found
    return checkpointed(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(later)))
