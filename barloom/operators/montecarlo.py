"""Simulation of books over drawn sessions with stops, choice of books, adaptive settings, gates.

Paths are keyed by a counter hash of (seed, reset, path, block), so any task can make any path; a group is a chunk of one
reset's paths, its bars are the window of sessions up to the reset, for the candidates only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import mix64
from barloom.operators.backtest import Settings

PATHS, BLOCK, WINDOW, CHUNK = 500, 5, 750, 100


def drawn(t0: int, paths: np.ndarray, horizon: int, block: int = BLOCK, window: int = WINDOW, skip: int = 0, seed: int = 1) -> np.ndarray:
    """Sessions of each path (rows) and step, in blocks that lie within the ``window`` sessions that end ``skip`` before t0."""
    high = t0 - skip
    low = max(1, high - window + 1)
    span = high + 1 - low - block + 1
    if span <= 0:
        return np.empty((len(paths), 0), np.int64)
    one = np.uint64(seed)
    with np.errstate(over="ignore"):
        keys = mix64(one ^ mix64(np.uint64(t0) * np.uint64(1_000_003) + paths.astype(np.uint64)))
        starts = [low + (mix64(keys + np.uint64(b)) % np.uint64(span)).astype(np.int64) for b in range(-(-horizon // block))]
    steps = np.stack(starts, axis=1)[:, :, None] + np.arange(block)
    return np.minimum(high, steps.reshape(len(paths), -1)[:, :horizon])


def drawn_in_states(t0: int, paths: np.ndarray, horizon: int, fit: dict, block: int = BLOCK, seed: int = 1) -> np.ndarray:
    """Sessions of each path drawn in the states of a regime fit whose sessions end at t0.

    A path starts in a state by today's chances; each block starts at a past session of its state (at any one, where
    the state has fewer than two blocks of sessions), and the state moves on with every session by the fit's matrix.
    """
    g, move = fit["g"], fit["move"]
    first, n, k = t0 - len(g) + 1, len(g), fit["k"]
    span = max(1, n - block + 1)
    likely = g[:span].argmax(axis=1)
    starts = [first + np.flatnonzero(likely == z) for z in range(k)]
    out = np.empty((len(paths), horizon), np.int64)
    for i, path in enumerate(paths.tolist()):
        count = 0

        def unit() -> float:
            nonlocal count
            count += 1
            with np.errstate(over="ignore"):
                key = mix64(np.uint64(seed) ^ mix64(np.uint64(t0) * np.uint64(1_000_003) + np.uint64(path)))
                return float(mix64(key + np.uint64(count)) >> np.uint64(11)) / (1 << 53)

        def pick(chances: np.ndarray) -> int:
            return int(min(np.searchsorted(np.cumsum(chances), unit(), side="right"), k - 1))

        z, at = pick(fit["now"]), 0
        while at < horizon:
            own = starts[z]
            begin = int(own[min(len(own) - 1, int(unit() * len(own)))]) if len(own) >= 2 * block else first + min(span - 1, int(unit() * span))
            for j in range(min(block, horizon - at)):
                out[i, at] = min(t0, begin + j)
                z, at = pick(move[z]), at + 1
    return out


def ahead_volatility(by_state: DataFrame, overall: DataFrame, fits: DataFrame, least: int = 20, least_all: int = 60) -> DataFrame:
    """(t0, ticker, sigma): the state deviations mixed by the chances of the states ahead.

    ``by_state`` has t0, ticker, state, weight and sigma; ``overall`` ticker's own t0, ticker, n and sigma; ``fits`` t0
    and ahead. A state with a weight under ``least`` sessions counts with the ticker's own variance; a ticker with
    under ``least_all`` sessions gets its own deviation.
    """
    ahead = fits.select("t0", F.posexplode("ahead").alias("state", "chance"))
    rows = overall.select("t0", "ticker", "n", F.col("sigma").alias("own")).join(ahead, "t0").join(by_state, ["t0", "ticker", "state"], "left")
    variance = F.when(F.coalesce("weight", F.lit(0.0)) >= least, F.col("sigma") * F.col("sigma")).otherwise(F.col("own") * F.col("own"))
    mixed = rows.groupBy("t0", "ticker").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.sum(F.col("chance") * variance).alias("v"))
    return mixed.select("t0", "ticker", F.when(F.col("n") < least_all, F.col("own")).otherwise(F.sqrt("v")).alias("sigma"))


def slot(
    bars: dict[str, np.ndarray], sessions: np.ndarray, s: Settings, sigma: float, lows: Sequence[float] = (), adj: float = 1.0, held_from: float | None = None, calm: float = 1.0
) -> tuple[float, bool]:
    """(return, stopped) of one slot over drawn sessions: bought at the first open within the limit, held, stopped by rule.

    ``bars`` has o, h, l, c relative to the close before, by session; a session without a bar is flat. With
    ``held_from`` the slot starts with the share, its stop at that level of the last close. ``calm`` scales the drawn
    moves to the volatility ahead. After a stop the buy-back order of ``rebuystop`` works, from its own day's close on.
    """
    price, worth, held, stopped = 1.0, 1.0, False, False
    level = sure = band = factor = extreme = top = trigger = 0.0
    leave = False
    past = list(lows)
    limit = 1 + min(s.capmax, s.capsd * (sigma if sigma > 0 else 0.02))

    def arm(paid: float) -> None:
        nonlocal level, sure, band, factor, extreme, top
        band = float(np.clip((s.psarvol or s.vstop) * sigma, 0.02, 0.5))
        if s.psarvol:
            level, factor, extreme = paid * (1 - band), s.psarstep, paid
        elif s.psar:
            below = min(past[-5:], default=np.inf)
            level, factor, extreme = (below if below < paid else 0.95 * paid), s.psarstep, paid
        elif s.vstop:
            level, sure, top = paid * (1 - band), paid * (1 - 1.5 * band), paid
        elif s.stop:
            level = paid * (1 - s.stop)

    if held_from is not None:
        held = True
        arm(1.0)
        level = held_from or level
    for q in sessions:
        o, h, low, c = (bars[k][q] for k in "ohlc")
        if not np.isfinite(o + h + low + c):
            continue
        o, h, low, c = (np.exp(np.log(x) * calm) if calm != 1.0 else x for x in (o, h, low, c))
        scale = price * adj
        po, ph, pl, pc = o * scale, h * scale, low * scale, c * scale
        within = False
        if held and leave:
            worth *= po / price
            held, leave, stopped = False, False, True
            trigger = level * (1 + s.rebuystop)
        elif not held and trigger and s.rebuystop and (po >= trigger or ph >= trigger):
            held, within, price = True, po < trigger, max(po, trigger)
            arm(price)
        elif not held and not stopped and po <= price * limit:
            held, price = True, po
            arm(po)
        if held:
            line = sure if s.vstop else level
            if line and pl <= line:
                worth *= (line if within else min(po, line)) / price
                held, stopped, trigger = False, True, level * (1 + s.rebuystop)
                if s.rebuystop and pc >= trigger:  # back on the stop's own day
                    held, price = True, trigger
                    arm(trigger)
                    worth *= pc / price
            else:
                worth *= pc / price
                if s.psar or s.psarvol:
                    if ph > extreme:
                        extreme, factor = ph, min(s.psarmax, factor + s.psarstep)
                    nxt = min(level + factor * (extreme - level), pl, past[-1] if past else pl)
                    level = max(level, min(nxt, pc * (1 - band)) if s.psarvol else nxt)
                elif s.vstop:
                    if pc < level:
                        leave = True
                    else:
                        top = max(top, pc)
                        level = max(level, top * (1 - band))
                        sure = max(sure, level * (1 - 0.5 * band))
        past.append(pl)
        price = pc
    return worth - 1, stopped


def drift(market: np.ndarray, own: np.ndarray) -> float:
    """A factor a session that takes a ticker's own drift over the window out, and puts the market's in."""
    own = own[np.isfinite(own)]
    return float(np.exp(market.mean() - own.mean())) if len(own) > 20 else 1.0


def simulate(panel: DataFrame, candidates: DataFrame, settings: Settings, paths: int = PATHS, horizon: int = 21, window: int = WINDOW, seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(t0, path, ticker, ret, stopped) for each candidate (t0, ticker) over each path.

    ``panel`` has t, ticker, o, h, l, c, cf, ret, sigma and mkt. A chunk of paths of a reset is one group.
    """
    own = panel.join(candidates.select("ticker").distinct(), "ticker", "left_semi").select("t", "ticker", "o", "h", "l", "c", "cf", "ret", "sigma", "mkt")
    rows = own.join(F.broadcast(candidates.select("t0", F.col("ticker").alias("wanted"))), (F.col("ticker") == F.col("wanted")) & F.col("t").between(F.col("t0") - window, F.col("t0"))).drop("wanted")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-paths // chunk) - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t0, part = int(key[0]), int(key[1])
        ids = np.arange(part * chunk, min(paths, (part + 1) * chunk))
        days = drawn(t0, ids, horizon, window=window, seed=seed)
        out = []
        for ticker, one in pdf.sort_values("t").groupby("ticker"):
            n = t0 + 1
            at = one["t"].to_numpy()
            full = {k: np.full(n, np.nan) for k in ("o", "h", "l", "c", "cf")}
            for k, v in full.items():
                v[at] = one[k].to_numpy(dtype=float)
            before = np.r_[np.nan, full["cf"][:-1]]
            rel = {k: full[k] / before for k in "ohlc"}
            last = one.iloc[-1]
            sigma = float(last["sigma"]) if pd.notna(last["sigma"]) else 0.02
            lows = [x for x in (full["l"][-5:] / full["cf"][-1]) if np.isfinite(x)]
            adj = drift(one["mkt"].to_numpy(dtype=float), one["ret"].to_numpy(dtype=float))
            for i, path in enumerate(ids):
                ret, stopped = slot(rel, days[i], settings, sigma, lows, adj)
                out.append((t0, int(path), ticker, ret, stopped))
        return pd.DataFrame(out, columns=["t0", "path", "ticker", "ret", "stopped"])

    return rows.groupBy("t0", "part").applyInPandas(run, "t0 long, path long, ticker string, ret double, stopped boolean")


def chosen(paths: DataFrame, k: int, by_growth: bool = False) -> DataFrame:
    """(t0, ticker, place): the k candidates of the best mean, or picked one by one for the book's mean log growth."""
    if not by_growth:
        mean = paths.groupBy("t0", "ticker").agg(F.avg("ret").alias("m"))
        place = F.row_number().over(Window.partitionBy("t0").orderBy(F.desc(F.round("m", 12)), "ticker")).cast("long") - 1
        return mean.withColumn("place", place).where(F.col("place") < k).select("t0", "ticker", "place")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="path", columns="ticker", values="ret").sort_index(axis=1)
        total, left, out = np.zeros(len(wide)), list(wide.columns), []
        while left and len(out) < k:
            best = max(left, key=lambda t: (float(np.log1p((total + wide[t].to_numpy()) / k).mean()), -left.index(t)))
            total += wide[best].to_numpy()
            left.remove(best)
            out.append((key[0], best, len(out)))
        return pd.DataFrame(out, columns=["t0", "ticker", "place"])

    return paths.groupBy("t0").applyInPandas(run, "t0 long, ticker string, place long")


def best_settings(results: DataFrame) -> DataFrame:
    """(t0, ticker, setting): of the simulated settings (t0, ticker, setting, ret) the one with the best mean, ties to the first."""
    mean = results.groupBy("t0", "ticker", "setting").agg(F.round(F.avg("ret"), 12).alias("m"))
    return mean.groupBy("t0", "ticker").agg(F.max_by("setting", F.struct("m", (-F.col("setting")).alias("n"))).alias("setting"))


def voted(settings: DataFrame) -> DataFrame:
    """(t0, setting): what most tickers of a reset chose, ties to the smaller."""
    n = settings.groupBy("t0", "setting").count()
    return n.groupBy("t0").agg(F.max_by("setting", F.struct("count", (-F.col("setting")).alias("s"))).alias("setting"))


def gated(record: DataFrame, last: int = 12) -> DataFrame:
    """(t0, on): whether the arm's edge over its rival (t0, edge) in the last resets, shrunk for significance, was positive.

    Only resets that were over by then count; a first reset is off.
    """
    from barloom.operators.evaluate import shrunk_mean

    w = Window.orderBy("t0").rowsBetween(-last, -1)
    n, s, ss = F.count("edge").over(w).cast("double"), F.sum("edge").over(w), F.sum(F.col("edge") * F.col("edge")).over(w)
    return record.withColumn("n", n).withColumn("v", F.when(F.col("n") >= 2, shrunk_mean(n, s, ss)).otherwise(0.0)).select("t0", (F.col("v") > 0).alias("on"))


def state_volatility(panel: DataFrame, gamma: DataFrame, k: int) -> DataFrame:
    """(t0, ticker, state, weight, sigma): deviation of returns weighted by the chance of each state on each session.

    ``gamma`` has t0, t and g, an array of k chances: the range join is on the sessions that a reset's model covers.
    """
    joined = panel.select("t", "ticker", "ret").where("ret is not null").join(gamma, "t").select("t0", "ticker", "ret", F.posexplode("g").alias("state", "w"))
    w, x = F.col("w"), F.col("ret")
    mean = F.sum(w * x) / F.sum(w)
    var = F.sum(w * x * x) / F.sum(w) - mean * mean
    return joined.where(F.col("state") < k).groupBy("t0", "ticker", "state").agg(F.sum(w).alias("weight"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sigma"))
