"""Approximate nearest neighbours: stable random projections indexed by a kd-tree.

Vectors are mapped to a few dimensions by Gaussian projections, for which a projected squared distance
divided by the true one follows a chi-square law. The vectors lie in blocks of bounded size, each with a
kd-tree over its projections. A query meets each block: leaves come in the order of their projected
distance, their vectors are verified with the true measure, and the search ends when the next
projected distance is so large that a vector nearer than the k-th found would, with probability
``sure``, have been projected closer. The best of all blocks are the result.

The measure is the largest inner product. One more coordinate, from the largest norm, turns it into a
Euclidean distance for the projection; verification uses the original vectors in double precision.
Null or zero vectors, those with null or non-finite components, and those of another length than most
take no part. Rows are told apart by position, so repeated ids are rows of their own; ties go to the
smaller vec_id; with fewer candidates than k all are returned; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkblot.llm.common import written

DIMS, LEAF, SURE, K = 8, 32, 0.97, 20
BLOCK, QUERIES = 8192, 8192
OUT = "query_id long, query_row long, vec_id long, vec_row long, score double"
SCHEMA = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("vec_row", pa.int64()), ("score", pa.float64())])


def chi_square(x: float, dof: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dof // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def stopping_ratio(sure: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dof) < sure else (low, middle)
    return high


def projection(dim: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(12345).normal(size=(dim, dims))


def kd_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in kd-tree order: split at the median of the widest dimension down to equal leaves; -1 fills up."""
    leaves = 1
    while leaves * leaf < len(points):
        leaves *= 2
    order = np.full(leaves * leaf, -1)
    todo = [(np.arange(len(points)), 0, leaves)]
    while todo:
        rows, at, n = todo.pop()
        if n == 1 or not len(rows):
            order[at * leaf : at * leaf + len(rows)] = rows
            continue
        some = points[rows]
        axis = int((some.max(axis=0) - some.min(axis=0)).argmax())
        half = (len(rows) + 1) // 2
        rows = rows[np.argpartition(some[:, axis], half - 1)]
        todo += [(rows[:half], at, n // 2), (rows[half:], at + n // 2, n // 2)]
    return order


class Block:
    """Vectors of one block with their kd-tree."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, largest: float, dims: int = DIMS):
        self.ids, self.rows = ids, rows
        self.axes = projection(vectors.shape[1] + 1, dims)
        # a power of two that makes the largest norm about 1: no square of it overflows, and products scale exactly
        self.scale = 2.0 ** -min(1022, max(-1022, math.frexp(largest)[1]))
        self.largest = largest * self.scale
        scaled = vectors * self.scale
        lifted = np.sqrt(np.maximum(0, self.largest**2 - np.einsum("ij,ij->i", scaled, scaled)))
        points = scaled @ self.axes[:-1] + lifted[:, None] * self.axes[-1]
        order = kd_order(points)
        self.order = order.reshape(-1, LEAF)
        there = self.order >= 0
        self.vectors = np.where(there[..., None], vectors[self.order], 0.0)
        leaves = points[self.order]
        self.low = np.where(there[..., None], leaves, np.inf).min(axis=1)
        self.high = np.where(there[..., None], leaves, -np.inf).max(axis=1)
        self.full = there.any(axis=1)

    def search(self, query: np.ndarray, own: int, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best found for one query, whose own row is ``own``."""
        small = query * self.scale
        at = small @ self.axes[:-1]
        gap = np.maximum(0, np.maximum(self.low - at, at - self.high))
        distance = np.where(self.full, np.einsum("ij,ij->i", gap, gap), np.inf)
        turn = np.argsort(distance, kind="stable")
        base = float(small @ small) + self.largest**2
        found, scores = np.empty(0, int), np.empty(0)
        done, step = 0, max(1, 2 * k // LEAF)
        while done < len(turn) and np.isfinite(distance[turn[done]]):
            if len(scores) == k and distance[turn[done]] > ratio * max(0.0, base - 2 * scores.min() * self.scale * self.scale):
                break
            some = turn[done : done + step]
            done, step = done + step, step * 2
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.nan_to_num(self.vectors[some].reshape(-1, self.vectors.shape[2]) @ query, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            places = self.order[some].reshape(-1)
            good = places >= 0
            if own >= 0:
                good &= self.rows[places] != own
            found, scores = np.concatenate((found, places[good])), np.concatenate((scores, values[good]))
            if len(scores) > k:
                best = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
        return found, scores


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``_row``, ``v`` (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select("vec_id", F.monotonically_increasing_id().alias("_row"), v.alias("v")).where("v is not null and vec_id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def _norm() -> Column:
    """The norm of ``v``, of which the largest component is taken out before anything is squared."""
    top = F.array_max(F.transform("v", F.abs))
    return top * F.sqrt(F.aggregate(F.transform("v", lambda x: x / top), F.lit(0.0), lambda s, x: s + x * x))


def search(vectors: DataFrame, is_query: Column, k: int = K, sure: float = SURE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row among all other rows.

    Query blocks meet index blocks pair by pair; a task holds one of each. Only k rows for each query
    and index block go on to be merged.
    """
    rows = written(usable(vectors), "ann-rows")  # numbered once: queries and index must agree on who is who
    facts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(_norm()).alias("norm")).first()
    n_blocks, n_queries = max(1, -(-facts["n"] // block)), max(1, -(-facts["q"] // queries))
    largest = min(float(facts["norm"] or 0) * (1 + 1e-12), 1.79e308)
    ratio = stopping_ratio(sure, DIMS)
    spot = F.xxhash64("vec_id", "_row")
    index = rows.select("vec_id", "_row", "v", F.pmod(spot, F.lit(n_blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("g"))
    asked = rows.where(is_query).select("vec_id", "_row", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.pmod(spot, F.lit(n_queries)).cast("int").alias("g"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = table.column("v").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), table.column("_row").to_numpy(), flat.reshape(len(column), -1)

    def pair(asked_part: pa.Table, index_part: pa.Table) -> pa.Table:
        out = []
        if len(asked_part) and len(index_part):
            held = Block(*matrix(index_part), largest)
            for qid, qrow, q in zip(*matrix(asked_part)):
                found, scores = held.search(q, qrow, k, ratio)
                n = len(found)
                out.append((np.full(n, qid), np.full(n, qrow), held.ids[found], held.rows[found], scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    found = asked.groupBy("g", "b").cogroup(index.groupBy("g", "b")).applyInArrow(pair, OUT)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def every_20th() -> Column:
    return F.col("vec_id") % 20 == 0
