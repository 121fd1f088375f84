"""Nearest neighbours by cosine with one vantage-point tree for each shard.

Vectors are scaled to length one, where the chord length orders as the cosine
and obeys the triangle inequality.  Every usable row goes to a shard by a hash
of its id; a shard's tree splits at the median distance from a vantage point.
A query first drops to one leaf for a bound, then walks the tree once: a side is
left out if ``factor`` times the query's distance to it exceeds the bound.
Factor one is exact; a larger one leaves out more and may miss neighbours.

Queries travel to the shards in blocks, so a task holds one shard and one block.
Scores are recomputed in double precision from the original vectors, in an order
that gives equal vectors equal scores; ties go to the smaller id.

Defined cases: rows with a null id or a null, zero or non-finite vector take no
part; vectors are compared with those of their own length, which have a cosine;
rows that repeat an id are candidates each, but never of a query with that id; of
repeated query ids the smallest vector counts; equal scores go by id; with fewer
than k candidates all are returned; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.llm._store import maybe_broadcast

#: Most vectors in a shard, fewest worth a shard of their own, shards wanted for small tables.
SHARD_ROWS, LEAST_ROWS, SHARDS = 100_000, 2_000, 24
#: Queries in a block.
BLOCK_QUERIES = 50_000
LEAF = 64
#: Bound on rounding in chord lengths.
SLACK = 1e-7


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


class VantageTree:
    """Rows in leaf order; a node is (vantage row, radius, low, middle, high): inside is low..middle."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.units = self.vectors / self.norms[:, None]
        self.nodes: list[tuple[int, float, int, int, int, int, int]] = []
        self.order = np.arange(len(ids))
        self.root = self._build(0, len(ids))

    def _build(self, low: int, high: int) -> int:
        """Node number, or -1 for a leaf; done with a stack, as equal vectors could make deep trees."""
        if high - low <= LEAF:
            return -1
        rows = self.order[low:high]
        vantage = rows[(len(rows) * 7) // 13]
        far = chord(self.units[rows] @ self.units[vantage])
        by = np.argsort(far, kind="stable")
        self.order[low:high] = rows[by]
        half = (high - low) // 2
        number = len(self.nodes)
        self.nodes.append(())
        radius_in, radius_out = float(far[by[half - 1]]), float(far[by[half]])
        left = self._build(low, low + half)
        right = self._build(low + half, high)
        self.nodes[number] = (int(vantage), radius_in, radius_out, low, low + half, high, left, right)
        return number

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best k for each query; -inf where there are fewer."""
        q = len(ids)
        self.q_ids, self.q_vectors = ids, vectors
        self.q_norms = np.sqrt((vectors * vectors).sum(1))
        self.q_units = vectors / self.q_norms[:, None]
        self.best = np.full((q, k), -np.inf)
        self.best_ids = np.full((q, k), np.iinfo(np.int64).max)
        self._drop(self.root, 0, len(self.ids), np.arange(q))
        self.best[:], self.best_ids[:], bound = -np.inf, np.iinfo(np.int64).max, self.best[:, -1].copy()
        self.floor = bound  # a score that k candidates are known to reach
        self._walk(self.root, 0, len(self.ids), np.arange(q), factor)
        return self.best, self.best_ids

    def _drop(self, node: int, low: int, high: int, queries: np.ndarray) -> None:
        while len(queries):
            if node < 0:
                self.floor = np.full(len(self.q_ids), -np.inf)
                return self._leaf(low, high, queries)
            vantage, r_in, r_out, low, middle, high, left, right = self.nodes[node]
            inside = chord(self.q_units[queries] @ self.units[vantage]) <= (r_in + r_out) / 2
            self._drop(left, low, middle, queries[inside])
            node, low, queries = right, middle, queries[~inside]

    def _walk(self, node: int, low: int, high: int, queries: np.ndarray, factor: float) -> None:
        if not len(queries):
            return
        if node < 0:
            self._leaf(low, high, queries)
            return
        vantage, r_in, r_out, low, middle, high, left, right = self.nodes[node]
        far = chord(self.q_units[queries] @ self.units[vantage])
        self._walk(left, low, middle, queries[factor * (far - r_in) <= self._reach(queries)], factor)
        self._walk(right, middle, high, queries[factor * (r_out - far) <= self._reach(queries)], factor)

    def _reach(self, queries: np.ndarray) -> np.ndarray:
        return chord(np.maximum(self.best[queries, -1], self.floor[queries])) + SLACK

    def _leaf(self, low: int, high: int, queries: np.ndarray) -> None:
        rows = self.order[low:high]
        for at in range(0, len(queries), 4096):
            some = queries[at : at + 4096]
            rough = self.q_units[some] @ self.units[rows].T
            need = np.maximum(self.best[some, -1], self.floor[some]) - 1e-9
            a, b = np.nonzero((rough >= need[:, None]) & (self.ids[rows][None, :] != self.q_ids[some][:, None]))
            if not len(a):
                continue
            qi, ri = some[a], rows[b]
            exact = (self.q_vectors[qi] * self.vectors[ri]).sum(1) / (self.q_norms[qi] * self.norms[ri])
            k = self.best.shape[1]
            held = np.unique(qi)
            who = np.concatenate([qi, np.repeat(held, k)])
            score = np.concatenate([exact, self.best[held].ravel()])
            ident = np.concatenate([self.ids[ri], self.best_ids[held].ravel()])
            order = np.lexsort((ident, -score, who))
            who, score, ident = who[order], score[order], ident[order]
            first = np.searchsorted(who, held)
            take = first[:, None] + np.arange(k)
            self.best[held], self.best_ids[held] = score[take], ident[take]


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def build_index(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """One row per length and shard: its tree.  Every usable row is in one."""
    good = usable(vectors, id_col, vector_col)
    sizes = good.groupBy("dim").agg(F.count("*").alias("n"))  # a row for each length of vectors
    wanted = F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD_ROWS), F.least(F.lit(SHARDS), F.floor(F.col("n") / LEAST_ROWS))).alias("shards")

    def build(table: pa.Table) -> pa.Table:
        tree = VantageTree(table.column("vec_id").to_numpy(), matrix(table.column("v")))
        return pa.table({"dim": table.column("dim")[:1].cast(pa.int32()), "shard": table.column("shard")[:1].cast(pa.int32()), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    dealt = good.join(maybe_broadcast(sizes.select("dim", wanted), 16), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def search(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, *, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """Each query's k nearest rows of the index: query_id, rank, vec_id, score.

    A query meets every shard of its length, once: with factor one any shard may hold
    a neighbour.
    """
    q = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = max(1, math.ceil(q.count() / BLOCK_QUERIES))
    shards = maybe_broadcast(index.select(F.col("dim").alias("of"), F.col("shard").alias("to")), 16)
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).join(shards, F.col("dim") == F.col("of")).select("vec_id", "v", "dim", F.col("to").alias("shard"), "block")

    def find(trees: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(trees) or not len(asked):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        tree = pickle.loads(trees.column("tree")[0].as_py())
        ids = asked.column("vec_id").to_numpy()
        scores, found = tree.search(ids, matrix(asked.column("v")), k, factor)
        some = np.isfinite(scores)
        return pa.table([pa.array(np.repeat(ids, k)[some.ravel()]), pa.array(found[some]), pa.array(scores[some])], names=names)

    on = ["dim", "shard", "block"]
    near = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(find, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
