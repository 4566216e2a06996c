"""Chart indicators and stateful series operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """mid, upper and lower band of the last n closes, from the n-th bar on."""
    w = Window.partitionBy("ticker").orderBy("d").rowsBetween(-(n - 1), 0)
    full = F.count("c").over(w) == n
    mid, sd = F.avg("c").over(w), F.stddev_pop("c").over(w)
    return bars.select("ticker", "d", "c", *(F.when(full, x).alias(k) for k, x in (("mid", mid), ("upper", mid + width * sd), ("lower", mid - width * sd))))


def parabolic_sar(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """(ticker, d, sar, rising): the two-sided Parabolic SAR, a recursion over each ticker's bars.

    It starts rising from the first bar's low. While rising the level moves towards the highest high by a factor that
    grows with each new one, not above the last two lows; a low at or under it turns it, from the extreme. Falling
    mirrors that. One ticker's bars are one group, as many rows as it has days.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d")
        high, low = rows["h"].to_numpy(), rows["l"].to_numpy()
        out, up = [], []
        rising, sar, ep, af = True, low[0], high[0], step
        for i in range(len(rows)):
            if i:
                sar += af * (ep - sar)
                if rising:
                    sar = min(sar, low[i - 1], low[max(i - 2, 0)])
                    if low[i] <= sar:
                        rising, sar, ep, af = False, ep, low[i], step
                    elif high[i] > ep:
                        ep, af = high[i], min(most, af + step)
                else:
                    sar = max(sar, high[i - 1], high[max(i - 2, 0)])
                    if high[i] >= sar:
                        rising, sar, ep, af = True, ep, high[i], step
                    elif low[i] < ep:
                        ep, af = low[i], min(most, af + step)
            out.append(sar)
            up.append(rising)
        return pd.DataFrame({"ticker": rows["ticker"], "d": rows["d"], "sar": out, "rising": up})

    return bars.select("ticker", "d", "h", "l").groupBy("ticker").applyInPandas(run, "ticker string, d date, sar double, rising boolean")


def flat_stretches(points: DataFrame, least: int = 15) -> DataFrame:
    """(key, begin, end, n): maximal runs of equal values of at least ``least`` points; ``points`` has key, at, x."""
    by = Window.partitionBy("key").orderBy("at")
    new = (~F.col("x").eqNullSafe(F.lag("x").over(by)) | F.lag("at").over(by).isNull()).cast("int")
    islands = points.withColumn("new", new).withColumn("island", F.sum("new").over(by))
    runs = islands.groupBy("key", "island").agg(F.min("at").alias("begin"), F.max("at").alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select("key", "begin", "end", "n")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before ``at``: one union and one window, no range join."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_l", F.lit(1)).unionByName(
        right.select(*by, at, F.col(value).alias("_v"), F.lit(0).alias("_l")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(at, "_l") if by else Window.orderBy(at, "_l")
    return both.withColumn(value, F.last("_v", True).over(w)).where("_l = 1").drop("_v", "_l")


def chart_ticks(curve: DataFrame, multiples: tuple[float, ...]) -> DataFrame:
    """(m, y): the multiples of the start that a curve of log wealth (u, w) covers, on its scale from 0 to 1."""
    ends = curve.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    rows = ends.select("*", F.explode(F.array(*map(F.lit, multiples))).alias("m")).where(F.log("m").between(F.col("lo"), F.col("hi")) & (F.col("hi") > F.col("lo")))
    return rows.select("m", ((F.log("m") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("y"))


def year_starts(sessions: DataFrame) -> DataFrame:
    """(label, x): each year of the sessions (t, d) and where its first one lies, from 0 to 1."""
    last = sessions.agg(F.greatest(F.lit(1), F.max("t")).alias("last"))
    first = sessions.groupBy(F.year("d").alias("label")).agg(F.min("t").alias("t"))
    return first.crossJoin(F.broadcast(last)).select("label", (F.col("t") / F.col("last")).alias("x"))


def chart_points(curve: DataFrame, most: int = 800) -> DataFrame:
    """(u, x): at most ``most`` points of a curve (u, w), scaled from 0 to 1, the last one always."""
    n = curve.agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.max("u").alias("end"))
    rows = curve.withColumn("i", F.row_number().over(Window.orderBy("u")) - 1).crossJoin(F.broadcast(n))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    scaled = F.coalesce(F.try_divide(F.col("w") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return rows.where((F.col("i") % step == 0) | (F.col("u") == F.col("end"))).select("u", scaled.alias("x"))
