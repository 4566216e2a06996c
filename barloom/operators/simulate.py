"""Block bootstrap of sessions, stop-free simulation of books, and its calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOD = 2147483648


def draw(*parts: Column) -> Column:
    """A counter-based draw in [0, 2**31), two rounds of a linear congruence over a mix of the parts; the same in any order."""
    mixed = F.lit(0).cast("long")
    for i, p in enumerate(parts):
        mixed = (mixed + p.cast("long") * (7919 + 104_729 * i)) % _MOD
    for _ in range(2):
        mixed = (mixed * 1103515245 + 12345) % _MOD
    return mixed


def bootstrap_days(resets: DataFrame, paths: int = 500, horizon: int = 21, block: int = 5, window: int = 750, seed: int = 1) -> DataFrame:
    """(t0, path, j, q): for each reset t0 and path the drawn session of each of ``horizon`` steps.

    Blocks of sessions start anywhere in the ``window`` sessions that end at t0, so nothing after t0 is drawn.
    """
    spark = resets.sparkSession
    blocks = -(-horizon // block)
    grid = resets.select("t0").crossJoin(F.broadcast(spark.range(paths).withColumnRenamed("id", "path"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low = F.greatest(F.lit(1), F.col("t0") - window + 1)
    span = F.col("t0") + 1 - low - block + 1
    start = low + F.floor(draw(F.lit(seed), F.col("t0"), F.col("path"), F.col("b")) / 65536).cast("long") % span
    rows = grid.where(span > 0).select("t0", "path", "b", start.alias("start")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return rows.select("t0", "path", (F.col("b") * block + F.col("i")).cast("long").alias("j"), F.least("t0", F.col("start") + F.col("i")).cast("long").alias("q")).where(F.col("j") < horizon)


def path_returns(drawn: DataFrame, panel: DataFrame, targets: DataFrame) -> DataFrame:
    """(t0, path, ticker, ret): compound return of each target over the drawn sessions; a missing return is flat."""
    moves = panel.where("ret is not null").select(F.col("t").alias("q"), "ticker", "ret")
    joined = drawn.join(targets.select("t0", "ticker"), "t0").join(moves, ["q", "ticker"], "left")
    return joined.groupBy("t0", "path", "ticker").agg(F.expm1(F.coalesce(F.sum("ret"), F.lit(0.0))).alias("ret"))


def book_returns(paths: DataFrame, k: int) -> DataFrame:
    return paths.groupBy("t0", "path").agg((F.sum("ret") / k).alias("ret"))


def quantiles(book: DataFrame, *by: str) -> DataFrame:
    """Mean, chance of a loss, and the 5, 50 and 95 per cent points (linear between ranks) of simulated returns."""
    q = F.percentile("ret", F.array(*(F.lit(x) for x in (0.05, 0.5, 0.95))))
    out = book.groupBy(*by).agg(F.avg("ret").alias("mean"), F.avg((F.col("ret") < 0).cast("double")).alias("p_loss"), q.alias("q"))
    return out.select(*by, "mean", "p_loss", F.col("q")[0].alias("p5"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"))


def calibration(book: DataFrame, real: DataFrame) -> DataFrame:
    """How simulated returns (t0, path, ret) stand to the real ones (t0, real): coverage of the band, mean rank, means, correlation."""
    own = quantiles(book, "t0").join(F.broadcast(real), "t0")
    pit = book.join(F.broadcast(real), "t0").groupBy("t0").agg(F.avg(F.when(F.col("ret") < F.col("real"), 1.0).when(F.col("ret") == F.col("real"), 0.5).otherwise(0.0)).alias("pit"))
    return own.join(pit, "t0").agg(
        F.count("*").alias("resets"),
        F.avg(F.col("real").between(F.col("p5"), F.col("p95")).cast("double")).alias("coverage"),
        F.avg("pit").alias("pit"),
        F.avg("mean").alias("simulated"),
        F.avg("real").alias("real"),
        F.corr("mean", "real").alias("correlation"),
    )
