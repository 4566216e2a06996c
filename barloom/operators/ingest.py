"""Ingestion: split inference, share lists, caches, snapshots, profiles, order selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import code_of, exchange_of

# The ratios a split may have.
RATIOS = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0, 100.0)


def _split_at(prev: float, o: float, c: float) -> list[float]:
    """Ratios, and their inverses, that both the close and the open moved by, near enough."""
    found = []
    for n in RATIOS:
        near, near_open = (0.1, 0.15) if n >= 5 else (0.03, 0.1)
        found += [q for q in (n, 1 / n) if abs(math.log(prev / c / q)) < near and abs(math.log(prev / o / q)) < near_open]
    return found


def _upper_median(x: pd.Series) -> float:
    x = sorted(v for v in x if v > 0)
    return x[len(x) // 2] if x else 0.0


def cross_rates(last: DataFrame) -> DataFrame:
    """(currency, rate): units for one EUR, from the last closes (pair, rate) of EURGBP, GBPUSD and EURAUD.

    GBP comes from EURGBP, USD through GBP, AUD from EURAUD; a currency whose pairs are missing or not positive is left out.
    """
    of = lambda pair: F.max(F.when((F.col("pair") == pair) & (F.col("rate") > 0), F.col("rate")))
    one = last.agg(of("EURGBP").alias("g"), of("GBPUSD").alias("d"), of("EURAUD").alias("a"))
    rows = [F.struct(F.lit(n).alias("currency"), x.alias("rate")) for n, x in (("EUR", F.lit(1.0)), ("GBP", F.col("g")), ("USD", F.col("g") * F.col("d")), ("AUD", F.col("a")))]
    return one.select(F.inline(F.array(*rows))).where("rate is not null")


def distinct_values(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, n, one count for each column): how many different values, other than null and empty, each group has."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_distinct(F.when(F.col(c) != "", F.col(c))).alias(c) for c in columns))


def kept_list(old: DataFrame, new: DataFrame, least: int = 300, share: float = 0.8) -> DataFrame:
    """``new`` unless it has shrunk: a list with fewer rows than ``least`` or than ``share`` of the old one leaves the old one."""
    counts = old.agg(F.count("*").alias("a")).crossJoin(new.agg(F.count("*").alias("b")))
    fine = counts.select((F.col("b") >= F.greatest(F.lit(float(least)), share * F.col("a"))).alias("fine"))
    both = old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    return both.join(F.broadcast(fine), F.col("is_new") == F.col("fine")).drop("is_new", "fine")


def pages_until_old(pages: DataFrame, pattern: str, most: int = 5) -> DataFrame:
    """Distinct codes of the pages (page, html) in order, up to the first page that has no new one, ``most`` pages at most."""
    found = pages.where(F.col("page") < most).select("page", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("code"))
    first = found.groupBy("code").agg(F.min("page").alias("page"))
    fresh = first.select("page").distinct()
    dry = pages.where(F.col("page") < most).select("page").distinct().join(fresh, "page", "left_anti").agg(F.coalesce(F.min("page"), F.lit(most)).alias("stop"))
    return first.join(F.broadcast(dry), F.col("page") < F.col("stop")).select("code")


def export_shares(bars: DataFrame, shares: DataFrame, most: int) -> DataFrame:
    """The exchange's export: valid bars of its ordinary shares, units, outliers and splits put right, jumpy ones left out, the most traded kept.

    ``shares`` has ticker, name and kind; ``most`` is how many tickers stay.
    """
    from barloom.operators import clean
    from barloom.sources.bars import valid

    listed = shares.where(ordinary(F.col("name"), F.col("kind"))).select("ticker")
    own = valid(bars.join(listed, "ticker", "left_semi")).withColumn("t", F.datediff("d", F.lit("1970-01-01").cast("date")))
    own = infer_splits(clean.drop_outliers(clean.repair_units(own).select("ticker", "d", *clean.PRICES, "v")))
    own = own.join(clean.jumpy(own).select("ticker"), "ticker", "left_anti")
    today = own.join(F.broadcast(own.agg(F.max("d").alias("d"))), "d")
    return own.join(most_traded_today(today, most).select("ticker"), "ticker", "left_semi")


def due(jobs: DataFrame, day: int, minute: int, tries: int = 3, wait: int = 10) -> DataFrame:
    """Jobs (job, at, done_day, tries, last_try) to run now: their minute has come, they aren't done today, and they may be tried again.

    A job that failed is tried again ``wait`` minutes after its last try, ``tries`` times at most.
    """
    again = (F.coalesce("tries", F.lit(0)) == 0) | ((F.col("tries") < tries) & (F.col("last_try") + wait <= minute))
    return jobs.where((F.col("at") <= minute) & (F.coalesce("done_day", F.lit(-1)) < day) & again)


def infer_splits(bars: DataFrame, window: int = 20) -> DataFrame:
    """Bars with splits undone that prices and volumes show: all before one are rescaled, and later ones see that.

    Windows mark the days whose prices moved near a ratio, with the volumes around them; only these days, a handful a
    ticker, are looked at one after the other, as a split changes the volumes before the next. What they give is
    applied like a list of splits.
    """
    from barloom.operators.clean import adjust_splits

    own = Window.partitionBy("ticker").orderBy("d")
    around = lambda lo, hi: F.collect_list("v").over(own.rowsBetween(lo, hi))
    marked = bars.select("ticker", "d", "o", "c", F.row_number().over(own).alias("n"), F.lag("c").over(own).alias("p"), around(-window, -1).alias("before"), around(0, window - 1).alias("after"))
    moved = F.exists(F.array(*(F.lit(math.log(n)) for n in RATIOS)), lambda n: F.abs(F.abs(F.log(F.col("p") / F.col("c"))) - n) < 0.1)

    def run(days: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for r in days.sort_values("n").itertuples():
            first = r.n - len(r.before)
            for q in _split_at(r.p, r.o, r.c):
                scaled = pd.Series([v * math.prod([x for n, _, x in found if n > first + i]) for i, v in enumerate(r.before)], dtype=float)
                before, after = _upper_median(scaled), _upper_median(pd.Series(r.after, dtype=float))
                if before > 0 and after > 0 and math.log(after / before) * (1 if q > 1 else -1) > 0.5 * abs(math.log(q)):
                    found.append((r.n, r.d, q))
        return pd.DataFrame([(days["ticker"].iloc[0], d, q) for _, d, q in found], columns=["ticker", "day", "ratio"])

    splits = marked.where(moved).groupBy("ticker").applyInPandas(run, "ticker string, day date, ratio double")
    return adjust_splits(bars.select("ticker", "d", *"ohlc", F.col("v").cast("double").alias("v")), splits).select("ticker", "d", *"ohlcv")


def ordinary(name: Column, kind: Column) -> Column:
    """Whether a listing looks like an ordinary share, by its kind and words of its name."""
    other = r"(?i)\b(notes?|due|pfd|preferred|depositary|debentures?|units?|rights?|warrants?|fund|trust|etf|index)\b|\d\s*%"
    return kind.isin("EQ", "Equity", "Common Stock") & ~name.rlike(other)


def most_traded_today(quotes: DataFrame, universe: int) -> DataFrame:
    """The ``universe`` tickers with the largest close times volume of the day, with their place."""
    order = Window.partitionBy("d").orderBy(F.desc(F.col("c") * F.col("v")), "ticker")
    return quotes.withColumn("place", F.row_number().over(order).cast("long") - 1).where(F.col("place") < universe)


def still_wanted(wanted: DataFrame, misses: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """``wanted`` without tickers that were missing within the last ``days``."""
    return wanted.join(misses.where(F.datediff(today, "seen") < days).select("ticker").distinct(), "ticker", "left_anti")


def profiles(names: DataFrame, profile: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Names with what there is of their profile and fundamentals; of repeated codes the last (by ``at``) counts."""
    last = lambda df: df.groupBy("code").agg(F.max_by(F.struct(*(c for c in df.columns if c not in ("code", "at"))), "at").alias("r")).select("code", "r.*")
    return names.join(last(profile), "code", "left").join(last(fundamentals), "code", "left")


def find(symbols: DataFrame, *prefixes: str) -> DataFrame:
    """Symbols whose code starts with one of the prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.upper("code").startswith(p.upper())
    return symbols.where(hit)


def snapshots(ticks: DataFrame, minutes: int = 5) -> DataFrame:
    """(month, ticker, day, rows): bars of a few minutes, as one list a day, for files by month."""
    seq = F.struct("ts", "at")
    slot = F.window("ts", f"{minutes} minutes")
    own = ticks.groupBy("ticker", slot.alias("w")).agg(F.min_by("x", seq).alias("o"), F.max("x").alias("h"), F.min("x").alias("l"), F.max_by("x", seq).alias("c"), F.count("*").alias("n"))
    day = F.to_date("w.start")
    rows = F.sort_array(F.collect_list(F.struct(F.date_format("w.start", "HH:mm").alias("stamp"), "o", "h", "l", "c", "n")))
    return own.groupBy(F.trunc(day, "month").alias("month"), "ticker", day.alias("day")).agg(rows.alias("rows"))


def recently_placed(log: DataFrame, held: DataFrame, since: Column) -> DataFrame:
    """Distinct tickers of orders placed from a day on, without the codes held."""
    placed = log.where((F.col("kind") == "placed") & (F.col("day") >= since)).select("ticker").distinct()
    return placed.withColumn("code", code_of(F.col("ticker"))).join(held.select("code"), "code", "left_anti").select("ticker")


def coverage(pool: DataFrame, bars: DataFrame) -> DataFrame:
    """Of each exchange, how many tickers of the pool there are, and how many with bars."""
    have = bars.select("ticker").distinct().withColumn("has", F.lit(1))
    return pool.join(have, "ticker", "left").groupBy(exchange_of(F.col("ticker")).alias("exchange")).agg(F.count("*").alias("pool"), F.count("has").alias("with_bars"))


def by_ticker_or_code(bars: DataFrame, asked: str) -> DataFrame:
    """Bars of the ticker asked for; without any, of the first ticker with that code."""
    code = asked.split(":")[-1]
    found = bars.where(code_of(F.col("ticker")) == code).select("ticker").distinct()
    pick = found.agg(F.min_by("ticker", F.struct((F.col("ticker") != asked).cast("int"), "ticker")).alias("ticker"))
    return bars.join(F.broadcast(pick), "ticker", "left_semi")


def tick_size(orders: DataFrame, bands: DataFrame) -> DataFrame:
    """Orders with the tick of their price band (``bands``: low, tick): the band of the greatest low not over the price.

    The bands are a short table that is sent as one array, so no range join is needed.
    """
    table = bands.agg(F.sort_array(F.collect_list(F.struct("low", "tick")), asc=False).alias("bands"))
    joined = orders.crossJoin(F.broadcast(table))
    return joined.withColumn("tick", F.get(F.filter("bands", lambda b: b["low"] <= F.col("price")), F.lit(0))["tick"]).drop("bands")


def outlook(orders: DataFrame, trades: DataFrame, slots: int, half_life: float = 10.0) -> DataFrame:
    """(expected, delivered, outlook): what the orders promise a day, and how much of their promises trades kept lately.

    ``orders`` has expected and hold; ``trades`` d, expected, ret, filled. Weights halve every ``half_life`` sessions.
    """
    promise = orders.agg((F.sum(F.col("expected") / F.greatest(F.lit(1.0), F.col("hold"))) / slots).alias("expected"))
    age = F.dense_rank().over(Window.orderBy(F.desc("d"))) - 1
    w = trades.where("filled").withColumn("w", F.pow(F.lit(0.5), age / half_life))
    got, want = F.sum(F.col("w") * F.col("ret")), F.sum(F.col("w") * F.col("expected"))
    kept = w.agg(F.when(want > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), got / want))).otherwise(0.0).alias("delivered"))
    return promise.crossJoin(F.broadcast(kept)).withColumn("outlook", F.col("expected") * F.col("delivered"))


def states(orders: DataFrame, fills: DataFrame, held: DataFrame) -> DataFrame:
    """(symbol, state): sold, held, bought, refused, waiting or none, the first that holds; each side is aggregated first."""
    o = orders.groupBy("symbol").agg(F.bool_or(F.col("status") == "refused").alias("refused"), F.bool_or(F.col("status") == "open").alias("open"))
    f = fills.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "B", F.col("qty")).otherwise(0)).alias("b"), F.sum(F.when(F.col("side") == "S", F.col("qty")).otherwise(0)).alias("s"))
    h = held.groupBy("symbol").agg(F.max("days").alias("days"))
    all_ = o.join(f, "symbol", "full").join(h, "symbol", "full")
    none = F.coalesce
    state = (
        F.when(none("s", F.lit(0)) > 0, "sold")
        .when(none("days", F.lit(0)) > 0, "held")
        .when(none("b", F.lit(0)) > 0, "bought")
        .when(none("refused", F.lit(False)), "refused")
        .when(none("open", F.lit(False)), "waiting")
        .otherwise("none")
    )
    return all_.select("symbol", state.alias("state"))


def selected(orders: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """At most n tickers to sample: the day's orders first, then candidates by rank, each once."""
    both = orders.select("ticker", "rank", F.lit(0).alias("late")).unionByName(candidates.select("ticker", "rank", F.lit(1).alias("late")))
    first = both.groupBy("ticker").agg(F.min(F.struct("late", "rank")).alias("at"))
    return first.orderBy("at", "ticker").limit(n).select("ticker", "at.late", "at.rank")


def by_stop_distance(orders: DataFrame, least: float = 0.005) -> DataFrame:
    """Buys with a stop farther than the day's upper median go, unless held; the rest by chance times net over the distance."""
    day = Window.partitionBy("t")
    dist = orders.withColumn("_all", F.sort_array(F.collect_list("distance").over(day)))
    cut = F.get("_all", F.floor(F.size("_all") / 2).cast("int"))
    kept = dist.where(F.col("held") | (F.col("distance") <= cut)).drop("_all")
    value = F.col("fill") * F.col("net") / F.greatest(F.lit(least), F.col("distance"))
    return kept.withColumn("place", F.row_number().over(day.orderBy(F.desc(value), "ticker")).cast("long") - 1)


def updates(target: DataFrame, flow: DataFrame, day: int, within: int = 260) -> DataFrame:
    """(ticker, keep): targets stay; tickers held within the last sessions that aren't targets go."""
    recent = flow.where(F.col("last_held") >= day - within).select("ticker")
    both = target.select("ticker", F.lit(True).alias("k")).unionByName(recent.withColumn("k", F.lit(False)))
    return both.groupBy("ticker").agg(F.bool_or("k").alias("keep"))
