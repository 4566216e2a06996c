"""Evaluation of rankings: stop-free backtest, records, expectations, walk-forward choice, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252.0


def targets(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") < k)


def held_days(panel: DataFrame, target: DataFrame, k: int, rebalance: int, warmup: int, capsd: float = 1.5, capmax: float = 0.03) -> DataFrame:
    """(u, ticker, change): daily changes of stop-free positions at fixed weights 1/k, without contention for slots.

    A target is bought at the first open within the limit of the day before (close and cap of that day), is held while it
    stays a target, and is sold at the first open after it isn't; a day's change is from the mark before.
    """
    by = Window.partitionBy("ticker").orderBy("t")
    seg = F.floor((F.col("t") - 1 - warmup) / rebalance)
    want = target.select("ticker", F.floor((F.col("t") - warmup) / rebalance).alias("seg"), F.lit(True).alias("want"))
    limit = F.lag("cf").over(by) * (1 + F.least(F.lit(capmax), capsd * F.coalesce(F.lag("sigma").over(by), F.lit(0.02))))
    days = panel.select("t", "ticker", "o", "cf", "sigma").withColumn("limit", limit).withColumn("prev", F.last("cf", True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    days = days.where(F.col("t") > warmup).withColumn("seg", seg).join(want, ["ticker", "seg"], "left")
    event = F.when(F.col("want") & (F.col("o") > 0) & (F.col("o") <= F.col("limit")), 1).when(F.col("want").isNull() & (F.col("o") > 0), 0)
    days = days.withColumn("event", event)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    # held after a day: the last event was a buy; while wanted, days without a fill keep the state
    days = days.withColumn("was", F.coalesce(F.last("event", True).over(past), F.lit(0))).withColumn("now", F.coalesce("event", "was"))
    change = (
        F.when((F.col("was") == 1) & (F.col("now") == 1), F.coalesce("cf", "prev") / F.col("prev") - 1)
        .when((F.col("was") == 1) & (F.col("now") == 0), F.col("o") / F.col("prev") - 1)
        .when((F.col("was") == 0) & (F.col("now") == 1), F.col("cf") / F.col("o") - 1)
    )
    return days.select(F.col("t").alias("u"), "ticker", change.alias("change"), F.when((F.col("was") == 0) & (F.col("now") == 1), F.col("o")).alias("entry"), F.when((F.col("was") == 1) & (F.col("now") == 0), F.col("o")).alias("exit"))


def daily_returns(positions: DataFrame, k: int) -> DataFrame:
    """(u, ret): the book's return a day; cash earns nothing."""
    return positions.groupBy("u").agg((F.coalesce(F.sum("change"), F.lit(0.0)) / k).alias("ret"))


def record(daily: DataFrame, *by: str) -> DataFrame:
    """Compound annual return, population Sharpe ratio and worst drawdown of daily returns (columns u, ret)."""
    order = Window.partitionBy(*by).orderBy("u").rowsBetween(Window.unboundedPreceding, 0) if by else Window.orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    wealth = daily.withColumn("w", F.sum(F.log1p("ret")).over(order))
    deep = wealth.withColumn("dd", 1 - F.exp(F.col("w") - F.greatest(F.max("w").over(order), F.lit(0.0))))
    n = F.count("*")
    return deep.groupBy(*by).agg(
        F.expm1(F.sum(F.log1p("ret")) * YEAR / n).alias("annual"),
        F.coalesce(F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * F.sqrt(F.lit(YEAR)), F.lit(0.0)).alias("sharpe"),
        F.max("dd").alias("drawdown"),
        n.alias("days"),
    )


def expected_by_rank(trades: DataFrame, prior: float = 50.0) -> DataFrame:
    """``trades`` (rank, opened, closed, ret) with expected: the mean of the rank's trades closed by then, shrunk to that of all.

    Trades closed on or before ``opened`` count, as they are known then.
    """
    closed = trades.select(F.col("closed").alias("at"), "rank", "ret")
    both = closed.unionByName(trades.select(F.col("opened").alias("at"), "rank", F.lit(None).cast("double").alias("ret")))
    # a row a rank and day before anything is put in order
    days = both.groupBy("rank", "at").agg(F.coalesce(F.sum("ret"), F.lit(0.0)).alias("s"), F.count("ret").alias("n"))
    upto = lambda w: (F.sum("s").over(w), F.sum("n").over(w))
    rs, rn = upto(Window.partitionBy("rank").orderBy("at"))
    own = days.select("rank", "at", rs.alias("rs"), rn.alias("rn"))
    s, n = upto(Window.orderBy("at"))
    every = days.groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select("at", s.alias("s"), n.alias("n"))
    mu = F.col("s") / (F.col("n") + prior)
    known = own.join(every, "at").select("rank", F.col("at").alias("opened"), ((F.col("rs") + prior * mu) / (F.col("rn") + prior)).alias("expected"))
    return trades.join(known, ["rank", "opened"])


def shrunk_mean(n: Column, s: Column, ss: Column) -> Column:
    """A mean times one less the inverse square of its t statistic, not below 0: nothing without significance."""
    mean = s / n
    var = F.greatest(ss / n - mean * mean, F.lit(0.0))
    t2 = F.try_divide(mean * mean * n, var)
    return F.when(n < 2, 0.0).when(var <= 1e-18, mean).otherwise(mean * F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.lit(1.0), t2), F.lit(1e18))))


def choose_k(daily: DataFrame, window: int = 250, least: int = 60) -> DataFrame:
    """(u, k, ret): the book size with the best shrunk mean over the days before, ties to the larger; ``daily`` has k, u, ret.

    Only days that every k has count; with fewer than ``least`` days before, the largest k is taken.
    """
    ks = daily.agg(F.count_distinct("k").alias("m"), F.max("k").alias("top"))
    common = daily.join(daily.groupBy("u").agg(F.count_distinct("k").alias("have")).join(F.broadcast(ks), F.col("have") == F.col("m")).select("u", "top"), "u")
    past = Window.partitionBy("k").orderBy("u").rowsBetween(-window, -1)
    n = F.count("ret").over(past).cast("double")
    s, ss = F.coalesce(F.sum("ret").over(past), F.lit(0.0)), F.coalesce(F.sum(F.col("ret") * F.col("ret")).over(past), F.lit(0.0))
    rated = common.withColumn("n", n).withColumn("value", F.when(F.col("n") > 0, F.round(shrunk_mean(n, s, ss), 12)).otherwise(0.0))
    pick = F.max_by(F.struct("k", "ret"), F.struct(F.when(F.col("n") >= least, F.col("value")).otherwise(0.0).alias("v"), "k"))
    return rated.groupBy("u").agg(pick.alias("p")).select("u", "p.k", "p.ret")
