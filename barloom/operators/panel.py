"""The dense panel and its rolling features.

All windows are by ticker in the order of the session number t, and look back only; the panel is dealt by ticker once.
Missing is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLL, VOL_WINDOW, VOL_MIN, VALUE_WINDOW = 5, 60, 40, 20


def by():
    """Sessions of a ticker in order. Windows are made when asked for, as they need a session."""
    return Window.partitionBy("ticker").orderBy("t")


def past():
    return by().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before():
    return by().rowsBetween(Window.unboundedPreceding, -1)


def back(n: int, skip: int = 0) -> Window:
    """The n sessions that end ``skip`` sessions ago."""
    return by().rowsBetween(-(n - 1) - skip, -skip)


def sessions(bars: DataFrame) -> DataFrame:
    """(t, d): the union of all days, numbered from 0. One row a day, so one task numbers them."""
    return bars.select("d").distinct().withColumn("t", F.row_number().over(Window.orderBy("d")).cast("long") - 1)


def dense(bars: DataFrame) -> DataFrame:
    """Every ticker on every session; null where it has no bar. The calendar and the tickers are small and broadcast."""
    tickers = bars.select("ticker").distinct()
    grid = sessions(bars).crossJoin(F.broadcast(tickers))
    return grid.join(bars, ["d", "ticker"], "left").select("t", "d", "ticker", "o", "h", "l", "c", "v")


def carry_forward(panel: DataFrame, roll: int = ROLL) -> DataFrame:
    """cf: the close, over at most ``roll`` missing sessions the one before."""
    last_t = F.max(F.when(F.col("c").isNotNull(), F.col("t"))).over(past())
    return panel.withColumn("cf", F.when(F.col("t") - last_t <= roll, F.last("c", True).over(past())))


def log_return(panel: DataFrame) -> DataFrame:
    """ret: log of cf over the cf before it, however long ago that was."""
    return panel.withColumn("pcf", F.last("cf", True).over(before())).withColumn("ret", F.when((F.col("cf") > 0) & (F.col("pcf") > 0), F.log(F.col("cf") / F.col("pcf")))).drop("pcf")


def ring(column: str, n: int) -> Window:
    """The last ``n`` non-null values up to a row, by their running count in ``column``."""
    return Window.partitionBy("ticker").orderBy(column).rangeBetween(-(n - 1), Window.currentRow)


def volatility(panel: DataFrame, window: int = VOL_WINDOW, least: int = VOL_MIN) -> DataFrame:
    """sigma: population deviation of the last ``window`` returns there are, from ``least`` on."""
    own = ring("_n", window)
    counted = panel.withColumn("_n", F.count("ret").over(past()))
    return counted.withColumn("sigma", F.when(F.count("ret").over(own) >= least, F.stddev_pop("ret").over(own))).drop("_n")


def upper_median(values: Column, n: Column | int) -> Column:
    """Element n/2, from 0, of the sorted values: of an even number the upper one of the middle two."""
    return F.get(F.sort_array(values), (F.floor(F.lit(n) / 2) if isinstance(n, int) else F.floor(n / 2)).cast("int"))


def traded_value(panel: DataFrame, window: int = VALUE_WINDOW, unit: float = 1.0) -> DataFrame:
    """value: upper median of close times volume of the last ``window`` bars; null without a bar that day."""
    one = F.when(F.col("c").isNotNull() & (F.col("v") >= 0), F.col("c") * F.col("v") / F.lit(unit))
    counted = panel.withColumn("_x", one).withColumn("_n", F.count("_x").over(past()))
    own = ring("_n", window)
    full = F.col("c").isNotNull() & (F.count("_x").over(own) == window)
    return counted.withColumn("value", F.when(full, upper_median(F.collect_list("_x").over(own), window))).drop("_x", "_n")


def first_bar(panel: DataFrame) -> DataFrame:
    """first_t: the session of a ticker's first bar, once it has had one."""
    return panel.withColumn("first_t", F.min(F.when(F.col("c").isNotNull(), F.col("t"))).over(past()))


def features(bars: DataFrame, roll: int = ROLL, unit: float = 1.0) -> DataFrame:
    return first_bar(traded_value(volatility(log_return(carry_forward(dense(bars), roll))), unit=unit))


def change(a: int, b: int = 0) -> Column:
    """cf of b sessions ago over that of a sessions ago, less one."""
    x, y = F.lag("cf", a).over(by()), F.lag("cf", b).over(by()) if b else F.col("cf")
    return F.when((x > 0) & (y > 0), y / x - 1)


def tradable(panel: DataFrame, min_price: float = 0.0, min_value: float = 0.0, warmup: int = 260, need_value: bool = True) -> DataFrame:
    """tradable: a real bar, price, history, volatility and, where the market has volumes, traded value."""
    ok = F.col("c").isNotNull() & (F.col("c") >= min_price) & (F.col("t") >= F.col("first_t") + warmup) & (F.col("sigma") > 1e-12)
    if need_value:
        ok = ok & F.col("value").isNotNull() & (F.col("value") >= min_value)
    return panel.withColumn("tradable", F.coalesce(ok, F.lit(False)))


def most_traded(panel: DataFrame, top: int, by_ticker: bool = True) -> DataFrame:
    """Only the day's ``top`` by value stay tradable. Of ties at the cut, ticker order counts (or, if not ``by_ticker``, the value)."""
    day = Window.partitionBy("t", "tradable")
    ranked = panel.withColumn("_r", F.row_number().over(day.orderBy(F.desc("value"), "ticker")))
    if by_ticker:
        ranked = ranked.withColumn("_cut", F.min(F.when(F.col("_r") <= top, F.col("value"))).over(day))
        ranked = ranked.withColumn("_r", F.sum((F.col("value") >= F.col("_cut")).cast("int")).over(day.orderBy("ticker").rowsBetween(Window.unboundedPreceding, 0)))
        keep = (F.col("value") >= F.col("_cut")) & (F.col("_r") <= top)
        return ranked.withColumn("tradable", F.col("tradable") & F.coalesce(keep, F.lit(False))).drop("_r", "_cut")
    return ranked.withColumn("tradable", F.col("tradable") & (F.col("_r") <= top)).drop("_r")


def market_return(panel: DataFrame) -> DataFrame:
    """(t, d, mkt): mean return over the tradable tickers, 0 on a day without any."""
    return panel.groupBy("t", "d").agg(F.coalesce(F.avg(F.when(F.col("tradable"), F.col("ret"))), F.lit(0.0)).alias("mkt"))


def with_market(panel: DataFrame) -> DataFrame:
    """``panel`` with the day's mkt; there is one row a session, so it is broadcast."""
    return panel.join(F.broadcast(market_return(panel).select("t", "mkt")), "t")
