"""Cleaning and joining of bar sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("o", "h", "l", "c")


def repair_units(panel: DataFrame) -> DataFrame:
    """Undoes changes of the price unit by a factor of 100, from the latest bar back; volumes stay."""
    later = Window.partitionBy("ticker").orderBy("t")
    real = panel.where("c is not null")
    q = F.col("c") / F.lead("c").over(later)
    step = F.when((q > 50) & (q < 200), -1).when((q > 0.005) & (q < 0.02), 1).otherwise(0)
    down = Window.partitionBy("ticker").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    scaled = real.withColumn("e", step).withColumn("k", F.pow(F.lit(100.0), F.sum("e").over(down)))
    return scaled.select("t", "d", "ticker", *((F.col(x) * F.col("k")).alias(x) for x in PRICES), "v")


def drop_outliers(bars: DataFrame) -> DataFrame:
    """Bars whose own prices contradict each other become missing."""
    bad = (F.col("l") > F.col("h")) | (F.col("l") < 0.5 * F.least("o", "c")) | (F.col("h") > 2 * F.greatest("o", "c")) | (F.col("o") <= 0) | (F.col("h") <= 0) | (F.col("l") <= 0)
    return bars.where(~bad)


def split_ratio(text: Column) -> Column:
    """The ratio that "2-1", "2:1", "2/1" or a number says; null for anything else."""
    pair = r"^\s*([0-9.]+)\s*[-:/]\s*([0-9.]+)\s*$"
    of = lambda i: F.regexp_extract(text, pair, i).try_cast("double")
    return F.coalesce(F.try_divide(of(1), of(2)), text.try_cast("double"))


def adjust_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars before a split have prices divided and volumes multiplied by its ratio; several splits compose.

    ``splits`` has ticker, day and ratio. The product of the ratios after each bar is found within its ticker.
    """
    marks = splits.where("ratio > 0").select("ticker", F.col("day").alias("d"), F.log("ratio").alias("lr"), F.lit(None).cast("struct<o:double,h:double,l:double,c:double,v:double>").alias("b"))
    rows = bars.select("ticker", "d", F.lit(0.0).alias("lr"), F.struct(*PRICES, "v").alias("b")).unionByName(marks)
    after = Window.partitionBy("ticker").orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("ticker", "d")
    k = F.exp(F.sum("lr").over(after) - F.sum("lr").over(same))
    return rows.withColumn("k", k).where("b is not null").select("ticker", "d", *((F.col(f"b.{x}") / F.col("k")).alias(x) for x in PRICES), (F.col("b.v") * F.col("k")).alias("v"))


def inverse(bars: DataFrame) -> DataFrame:
    """Series of the inverse prices, under the code and a minus sign."""
    return bars.where("o > 0 and h > 0 and l > 0 and c > 0").select(
        F.concat("ticker", F.lit("-")).alias("ticker"), "d", (1 / F.col("o")).alias("o"), (1 / F.col("l")).alias("h"), (1 / F.col("h")).alias("l"), (1 / F.col("c")).alias("c"), "v"
    )


def nearest_scale(ratio: Column, scales: tuple[float, ...] = (1.0, 0.01, 100.0), most: float = 0.2) -> Column:
    """The scale nearest to ``ratio`` in logs; null if it is ``most`` or more away."""
    best = F.array_min(F.array(*(F.struct(F.abs(F.log(ratio / s)).alias("e"), F.lit(s).alias("s")) for s in scales)))
    return F.when((ratio > 0) & (best["e"] <= most), best["s"])


def override(bars: DataFrame, other: DataFrame, most: float = 0.2) -> DataFrame:
    """Cells of ``other`` replace those of ``bars``, brought to their unit; where no unit fits they don't."""
    theirs = other.select("ticker", "d", *(F.col(x).alias(f"n{x}") for x in (*PRICES, "v")))
    joined = bars.join(theirs, ["ticker", "d"], "left").withColumn("s", nearest_scale(F.col("c") / F.col("nc"), most=most))
    pick = [F.when(F.col("s").isNotNull(), F.col(f"n{x}") * F.col("s")).otherwise(F.col(x)).alias(x) for x in PRICES]
    return joined.select("ticker", "d", *pick, F.when(F.col("s").isNotNull(), F.col("nv")).otherwise(F.col("v")).alias("v"))


def splice(new: DataFrame, old: DataFrame, low: float = 0.004, high: float = 250.0) -> DataFrame:
    """Days of ``old`` before ``new`` begins, scaled by the closes of the first common day; ignored if the scale is outside the guard."""
    common = new.join(old.select("ticker", "d", F.col("c").alias("oc")), ["ticker", "d"]).where("oc > 0")
    scale = common.groupBy("ticker").agg(F.min_by(F.col("c") / F.col("oc"), "d").alias("k")).where((F.col("k") > low) & (F.col("k") < high))
    begin = new.groupBy("ticker").agg(F.min("d").alias("begin"))
    more = old.join(scale, "ticker").join(begin, "ticker").where("d < begin").select("ticker", "d", *((F.col(x) * F.col("k")).alias(x) for x in PRICES), "v")
    return new.select("ticker", "d", *PRICES, "v").unionByName(more)


def first_with_bars(bars: DataFrame, preference: DataFrame) -> DataFrame:
    """Of each code only the bars of its most preferred exchange that has any. ``bars`` has code and exchange."""
    has = bars.select("code", "exchange").distinct().join(F.broadcast(preference), ["code", "exchange"])
    best = has.groupBy("code").agg(F.min_by("exchange", "pref").alias("exchange"))
    return bars.join(best, ["code", "exchange"], "left_semi")


def join_history(bars: DataFrame, others: DataFrame, least: int) -> DataFrame:
    """Tickers with under ``least`` bars get the days before their first from another exchange, the most preferred with any."""
    short = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.min("d").alias("begin")).where(F.col("n") < least)
    more = others.join(short, "ticker").where("d < begin")
    best = more.groupBy("ticker").agg(F.min("pref").alias("pref"))
    return bars.unionByName(more.join(best, ["ticker", "pref"]).select(*bars.columns))


def jumpy(bars: DataFrame, jump: float = 1.6, back: float = 1.25, within: int = 5) -> DataFrame:
    """Tickers with a close-to-close jump that doesn't come back within the next bars."""
    by = Window.partitionBy("ticker").orderBy("d")
    prev = F.lag("c").over(by)
    ahead = F.collect_list("c").over(by.rowsBetween(0, within))
    rows = bars.select("ticker", "c", prev.alias("p"), ahead.alias("a"))
    stays = ~F.exists("a", lambda x: F.abs(F.log(x / F.col("p"))) < F.log(F.lit(back)))
    return rows.where((F.abs(F.log(F.col("c") / F.col("p"))) > F.log(F.lit(jump))) & stays).select("ticker").distinct()


def fetch_plan(stored: DataFrame, latest: Column, before: Column) -> DataFrame:
    """What each ticker needs: all, the last quote, the gap, or nothing, by its last stored day."""
    last = stored.groupBy("ticker").agg(F.max("d").alias("last"))
    plan = F.when(F.col("last").isNull(), "full").when(F.col("last") >= latest, "current").when(F.col("last") == before, "quote").otherwise("gap")
    return last.withColumn("plan", plan)


def valid_day_list(quotes: DataFrame, least: int = 20) -> DataFrame:
    """Days whose quote list can stand for all: every row is of that day, and there are enough."""
    return quotes.groupBy("list_day").agg(F.bool_and(F.col("d") == F.col("list_day")).alias("same"), F.count("*").alias("n")).where(F.col("same") & (F.col("n") >= least))
