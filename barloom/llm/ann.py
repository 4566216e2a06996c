"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each part of the table posts its vectors in one inverted
file a pivot, with the pivot's place in their order. A query adds up, over the files of its own nearest pivots, how
near the two places are; that sum ranks vectors as the footrule distance of the two orders does. The best share is
ranked again by the exact inner product in double precision. The table is dealt into parts, queries into blocks, and
every block meets every part; each returns its best few, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import columns

K = 20
#: Pivots, and how many of the nearest make a vector's order.
PIVOTS, PREFIX = 64, 32
#: Rows that pivots are picked from, at most: those with the least hash of their vectors.
SAMPLE = 512
#: The share of a part that is ranked again, and the least number.
SHARE, LEAST = 0.25, 200
#: Vectors of a part and queries of a block, about.
PART, QUERIES = 16384, 4096


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles; null, empty, zero ones and any with a null or non-finite component don't."""
    own = columns(vectors, vec_id=id_col, v=vec_col).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Pivots spread over the directions of a sample: each next one is the farthest from those picked; at most ``count``."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    picked, near = [0], unit @ unit[0]
    while len(picked) < min(count, len(unit)):
        nxt = int(np.argmin(near))
        if near[nxt] > 1 - 1e-12:
            break
        picked.append(nxt)
        near = np.maximum(near, unit @ unit[nxt])
    return unit[picked]


def orders(v: np.ndarray, pivot: np.ndarray, prefix: int) -> np.ndarray:
    return np.argsort(-(v @ pivot.T), axis=1, kind="stable")[:, : min(prefix, len(pivot))]


class Part:
    """The inverted files of one part of the table."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivot: np.ndarray, prefix: int = PREFIX) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, v = ids[by_id], v[by_id]
        self.ids, self.v, self.pivot, self.prefix = ids, v, pivot, prefix
        order = orders(v, pivot, prefix)
        place = np.tile(np.arange(order.shape[1], dtype=np.int32), len(v))
        by = np.argsort(order.ravel(), kind="stable")
        self.row, self.place = (np.repeat(np.arange(len(v)), order.shape[1])[by], place[by])
        self.begin = np.searchsorted(order.ravel()[by], np.arange(len(pivot) + 1))

    def candidates(self, order: np.ndarray, budget: int) -> np.ndarray:
        """Rows of the least footrule distance to a query's order, ties to the smaller id; one that shares no pivot is farthest."""
        if budget >= len(self.ids):
            return np.arange(len(self.ids))
        near = np.zeros(len(self.ids), np.int32)
        k = len(order)
        for at, p in enumerate(order.tolist()):
            own = slice(self.begin[p], self.begin[p + 1])
            # a pivot that only one order has counts as its place next after the last
            near[self.row[own]] += (k - at) + (k - self.place[own]) - np.abs(self.place[own] - at)
        edge = -np.partition(-near, budget - 1)[budget - 1]
        sure, tied = np.flatnonzero(near > edge), np.flatnonzero(near == edge)  # ids rise with the rows
        return np.r_[sure, tied[: budget - len(sure)]]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        budget = max(least, k + 1, int(share * len(self.ids)))
        for one, v, order in zip(query_ids.tolist(), q, orders(q, self.pivot, self.prefix)):
            rows = self.candidates(order, budget)
            score = np.einsum("ij,j->i", self.v[rows], v)
            if len(rows) > k:
                edge = np.partition(-score, k - 1)[k - 1]
                keep = -score <= edge
                rows, score = rows[keep], score[keep]
            best = np.lexsort([self.ids[rows], -score])[:k]
            yield one, self.ids[rows[best]], score[best]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    share: float = SHARE,
    least: int = LEAST,
    prefix: int = PREFIX,
    count: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by the largest inner product, ties to the smaller id.

    The pivots come from at most SAMPLE rows; every row is indexed. Of vectors that are equal, the k + 1 smallest ids
    stand for all, as no other can be among the k nearest; equal queries are searched once. A row is never its own
    neighbour. Vectors that ``valid`` leaves out neither ask nor answer, nor do those of another length than most (of
    equally frequent lengths the smaller one); of rows with one id the one with the least vector counts. The parts
    depend on ids and their number alone, and ties at every cut go to the smaller id, so partitioning changes nothing.
    No vectors give an empty result.
    """
    spark = vectors.sparkSession
    held, wanted = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    sizes = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 0
    base, asks = (x.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v")) for x in (held, wanted))
    picked = [r.v for r in base.select("v").orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).collect()]
    schema = "query_id long, vec_id long, score double"
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivot = pivots(np.array(picked), count)
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    first = base.withColumn("h", F.xxhash64("v")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v")
    n_parts = max(1, -(-base.count() // PART))
    dealt = first.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int"))
    # equal queries: one asks, and its answers (one more than k) serve all
    grouped = asks.groupBy("v").agg(F.min("vec_id").alias("ask"))
    n_blocks = max(1, -(-asks.count() // QUERIES))
    blocks = grouped.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(n_blocks)).cast("int"))
    left = dealt.select("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "vec_id", "v")
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "block", "ask", "v")

    def run(table: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(table) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        part = Part(table["vec_id"].to_numpy(), np.stack(table["v"].to_numpy()), pivot, prefix)
        out = [(np.full(len(i), q), i, s) for q, i, s in part.search(wanted["ask"].to_numpy(), np.stack(wanted["v"].to_numpy()), k + 1, share, least)]
        q, i, s = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    # a query finds itself here, as its equals may have to; it is left out at the end
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(run, schema).withColumnRenamed("query_id", "ask")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("ask", "vec_id", "score")
    members = asks.join(grouped, "v").select("ask", F.col("vec_id").alias("query_id"))
    pairs = members.join(found, "ask").where("query_id != vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
