"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage


def joined_apart(many: DataFrame, one: DataFrame, key: str, of: str) -> DataFrame:
    """``many`` with its row of ``one``, a table just grouped by ``of``; a key that has very many rows can be split over tasks.

    Joined where the groups were made, all rows of a key would have to meet there. The key is written as an expression,
    so that ``one`` is dealt out again and the join is on its own. It merges sorted rows at any size: a broadcast would
    bring ``one`` to the driver, a job and a table there for each of the many joins of the rounds.
    """
    dealt = one.withColumn(of, F.col(of).bitwiseXOR(F.lit(0).cast("long"))).hint("merge")
    return many.join(dealt, F.col(key) == F.col(of)).drop(of)


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): the named pairs of columns of each row; unlike a union, this makes the rows once."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the least of u and all its partners. The minimum is combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    return joined_apart(pairs, least, "u", "of")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _each(edges, ("u", "v"), ("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    return _each(near, ("v", "m"), ("u", "m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node that can be reached.

    Self-loops and repeated edges change nothing; an edge with a null end is ignored; no edges give no rows. Each
    round ends in a checkpoint, so a lost executor costs one round at most; the number of rounds grows as the
    logarithm of the number of nodes.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    seen = None
    now = cut_lineage(now)
    while True:
        now = cut_lineage(_small_star(_large_star(now)).where("u != v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
