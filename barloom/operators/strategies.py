"""Scoring strategies: one score a ticker and day, higher is wanted, null is not. Register more with ``strategy``."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.panel import back, by, change, past

COMMON = {"rebalance": 21, "warmup": 260, "capsd": 1.5, "capmax": 0.03, "maxdays": 260}
REGISTRY: dict[str, tuple[Callable[[Mapping[str, float]], Column], dict[str, float], str]] = {}


def strategy(name: str, about: str, **defaults: float):
    """Registers a function of the parameters that returns the score as a column over the panel with mkt.

    It may return a pair instead: named windows that the score is made of, each then computed once, and the score.
    """

    def add(f):
        REGISTRY[name] = (f, COMMON | defaults, about)
        return f

    return add


def parameters(name: str, **given: float) -> dict[str, float]:
    if name not in REGISTRY:
        raise KeyError(f"no strategy {name}")
    known = REGISTRY[name][1]
    if extra := set(given) - set(known):
        raise KeyError(f"{name} has no parameters {sorted(extra)}")
    return known | given


@strategy("momentum", "last year's change without the last month", lookback=252, skip=21)
def momentum(p):
    return F.when(F.col("t") >= p["lookback"], change(int(p["lookback"]), int(p["skip"])))


@strategy("trend", "last year's gain over its volatility", rebalance=5, lookback=252)
def trend(p):
    r = change(int(p["lookback"]))
    return F.when((F.col("t") >= p["lookback"]) & (r > 0) & (F.col("sigma") > 1e-12), r / (F.col("sigma") * F.sqrt(F.lit(float(p["lookback"])))))


@strategy("lowvol", "lowest volatility of a year", window=252)
def lowvol(p):
    n = int(p["window"])
    sd = F.stddev_pop("ret").over(back(n))
    return F.when((F.count("ret").over(back(n)) >= -(-n * 8 // 10)) & (sd > 1e-12), -sd)


def trailing(value: Column, n: int, skip: int = 0) -> Column:
    """Sum of ``value`` over the n sessions that end ``skip`` sessions ago: a difference of running sums.

    A sliding frame would add up its n rows anew for every row; running sums are made once. Sums of returns stay small,
    so the difference loses nothing that shows.
    """
    total = F.sum(F.coalesce(value, F.lit(0.0))).over(past())
    at = lambda k: F.coalesce(F.lag(total, k).over(by()), F.lit(0.0)) if k else total
    return at(skip) - at(skip + n)


def _sums(n: int, skip: int = 0) -> dict[str, Column]:
    """Sums over the sessions with a return: n, x (market), y (return), xx, xy, yy."""
    both = lambda e: F.when(F.col("ret").isNotNull(), e)
    x, y = F.col("mkt"), F.col("ret")
    return {k: trailing(both(v), n, skip) for k, v in {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}.items()}


@strategy("reversal", "a week's fall beyond the market's", rebalance=5, window=5, beta=252)
def reversal(p):
    b, n = int(p["beta"]), int(p["window"])
    w = back(n)
    parts = {f"_{k}": v for k, v in _sums(b).items()} | {"_rn": F.count("ret").over(w), "_rs": F.sum("ret").over(w), "_ms": F.sum("mkt").over(w)}
    s = {k.removeprefix("_"): F.col(k) for k in parts}
    den = s["n"] * s["xx"] - s["x"] * s["x"]
    beta = F.when(den > 1e-14, (s["n"] * s["xy"] - s["x"] * s["y"]) / den).otherwise(0.0)
    resid = s["rs"] - beta * s["ms"]
    z = resid / (F.col("sigma") * F.sqrt(F.lit(float(n))))
    ok = (s["rn"] == n) & (s["n"] >= 0.8 * b) & (F.col("sigma") > 1e-12)
    return parts, F.when(ok & (z < 0), -z)


@strategy("resmom", "last year's return beyond the market's, over its noise", lookback=252, skip=21)
def resmom(p):
    n, skip = int(p["lookback"]), int(p["skip"])
    parts = {f"_{k}": v for k, v in _sums(n - skip, skip).items()}
    s = {k.removeprefix("_"): F.col(k) for k in parts}
    den = s["n"] * s["xx"] - s["x"] * s["x"]
    beta = F.when(den > 1e-14, (s["n"] * s["xy"] - s["x"] * s["y"]) / den).otherwise(0.0)
    alpha = (s["y"] - beta * s["x"]) / s["n"]
    var = (s["yy"] - s["y"] * s["y"] / s["n"]) / s["n"] - beta * (s["xy"] - s["x"] * s["y"] / s["n"]) / s["n"]
    return parts, F.when((s["n"] >= 120) & (var > 1e-14), alpha * F.sqrt(s["n"]) / F.sqrt(F.greatest(var, F.lit(0.0))))


@strategy("high52", "nearness to the year's highest close", lookback=252)
def high52(p):
    n = int(p["lookback"])
    return F.when((F.col("t") >= n) & (F.col("cf") > 0), F.col("cf") / F.max("cf").over(back(n)))


@strategy("lowmax", "lowest best day of a month", window=21)
def lowmax(p):
    n = int(p["window"])
    return F.when(F.count("ret").over(back(n)) >= n / 2, -F.max("ret").over(back(n)))


@strategy("ltrev", "worst of the three years before the last", warmup=760, lookback=756, skip=252)
def ltrev(p):
    return -change(int(p["lookback"]), int(p["skip"]))


def scores(panel: DataFrame, name: str, invert: bool = False, **given: float) -> DataFrame:
    """(t, d, ticker, score, tradable, ...): the panel with the strategy's score; ``invert`` negates it."""
    p = parameters(name, **given)
    score = REGISTRY[name][0](p)
    parts, score = score if isinstance(score, tuple) else ({}, score)
    return panel.withColumns(parts).withColumn("score", -score if invert else score).drop(*parts)


def rebalance_days(rows: DataFrame, rebalance: int, warmup: int) -> DataFrame:
    return rows.where((F.col("t") >= warmup) & ((F.col("t") - warmup) % rebalance == 0))


def ranked(rows: DataFrame) -> DataFrame:
    """rank from 0 of the wanted, tradable tickers of each day, by score, then ticker."""
    wanted = rows.where(F.col("tradable") & F.col("score").isNotNull())
    return wanted.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "ticker")).cast("long") - 1)


# What a score says, in words: a format and the number in it.
_REASONS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "momentum": ("rose %.1f%% in the year before the last month", lambda s: 100 * s),
    "trend": ("gained %.2f times its yearly volatility", lambda s: s),
    "lowvol": ("moves %.2f%% a day, among the least", lambda s: -100 * s),
    "reversal": ("fell %.2f volatilities more in a week than the market explains", lambda s: s),
    "resmom": ("beat the market by %.2f standard errors in the year before the last month", lambda s: s),
    "high52": ("closes %.1f%% below its highest of a year", lambda s: 100 * (1 - s)),
    "lowmax": ("gained at most %.2f%% on any day of a month", lambda s: 100 * F.expm1(-s)),
    "ltrev": ("moved %.1f%% in the three years to a year ago", lambda s: -100 * s),
}


def reason(name: str, score: Column) -> Column:
    """A sentence on why a strategy wants a ticker, from its score."""
    text, number = _REASONS[name]
    return F.format_string(text, number(score))


def pool(lists: DataFrame, size: int) -> DataFrame:
    """Candidates of several strategies' lists in turn: rank by rank, each ticker once, at its first place."""
    first = lists.groupBy("t", "ticker").agg(F.min(F.struct("rank", "strategy")).alias("at"))
    order = Window.partitionBy("t").orderBy("at", "ticker")
    return first.withColumn("place", F.row_number().over(order).cast("long") - 1).where(F.col("place") < size).select("t", "ticker", "at.rank", "at.strategy", "place")


def cross_rank(column: str) -> Column:
    """Rank of the day's values from -0.5 to 0.5, ties by ticker."""
    day = Window.partitionBy("t")
    n = F.count(column).over(day)
    r = F.row_number().over(day.orderBy(F.col(column).asc_nulls_last(), "ticker"))
    return F.when(F.col(column).isNotNull() & (n > 1), (r - 1) / (n - 1) - 0.5)
