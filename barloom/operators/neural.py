"""Samples of the small net and its walk-forward training.

A sample is a ticker on a reset with what is known then, and the return that follows, which is known ``horizon`` sessions
later. At a reset only samples that are ready by then train the net that judges the reset's candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.models import Net
from barloom.operators.panel import back, by, change
from barloom.operators.strategies import cross_rank

RANKED = ("m12", "m6", "m1", "w1", "vol63", "vol252", "high", "value", "sigma")
#: Samples that a reset trains on, at most: the latest.
MOST = 40_000


def samples(panel: DataFrame, rebalance: int = 21, warmup: int = 260, horizon: int = 21) -> DataFrame:
    """(t, ticker, x, y, ready): inputs as an array of 17 numbers, all from sessions up to t, and the log return after it.

    Nine cross-section ranks, the market's year and volatility, and six numbers of the ticker itself, clamped.
    """
    clamp = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), F.coalesce(c, F.lit(0.0))))
    raw = {
        "m12": change(252, 21),
        "m6": change(126, 21),
        "m1": change(21),
        "w1": change(5),
        "vol63": F.stddev_pop("ret").over(back(63)),
        "vol252": F.stddev_pop("ret").over(back(252)),
        "high": F.col("cf") / F.max("cf").over(back(252)) - 1,
        "mkt12": F.sum("mkt").over(back(252)),
        "mktvol": F.stddev_pop("mkt").over(back(63)),
        "y": F.log(F.lead("cf", horizon).over(by()) / F.col("cf")),
    }
    rows = panel.select("t", "ticker", "tradable", "cf", "value", "sigma", "ret", *(v.alias(k) for k, v in raw.items()))
    rows = rows.where(F.col("tradable") & (F.col("t") >= warmup) & ((F.col("t") - warmup) % rebalance == 0))
    own = [clamp(F.col("m12"), -1.0, 1.0), clamp(F.col("m1"), -0.5, 0.5), clamp(F.col("w1"), -0.3, 0.3), clamp(F.col("high"), -1.0, 0.0), clamp(F.col("sigma") * 10, 0.0, 1.0), F.lit(1.0)]
    market = [clamp(F.col("mkt12"), -1.0, 1.0), clamp(F.col("mktvol") * 10, 0.0, 1.0)]
    x = F.array(*(F.coalesce(cross_rank(c), F.lit(0.0)).cast("float") for c in RANKED), *(c.cast("float") for c in (*market, *own)))
    return rows.select("t", "ticker", x.alias("x"), "y", "sigma", (F.col("t") + horizon).alias("ready"))


def walk_forward(rows: DataFrame, epochs: int = 2, horizon: int = 21, most: int = MOST, step: int = 0) -> DataFrame:
    """(t, ticker, mu, scale): the net's mean and scale factor for each sample, trained only on samples ready by t.

    With ``step`` the net also learns one epoch every so many sessions between the resets, on what is ready by then.
    Training is sequential, so all resets are one group: a few thousand samples a year.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "ticker"]).reset_index(drop=True)
        x = np.stack(pdf["x"].to_numpy()).astype(np.float32).astype(float)
        y = pdf["y"].to_numpy(dtype=float) / horizon
        sd = np.maximum(pdf["sigma"].to_numpy(dtype=float), 1e-4) / np.sqrt(horizon)
        net, out = Net(), []
        ready = pdf["ready"].to_numpy()

        def learn(t: int, rounds: int) -> None:
            known = np.flatnonzero((ready <= t) & np.isfinite(y))[-most:]
            net.train(x[known], y[known], sd[known], rounds)

        before = None
        for t, own in pdf.groupby("t"):
            if step and before is not None:
                for between in range(before + step, t, step):
                    learn(between, 1)
            before = t
            learn(t, epochs)
            _, mu, scale = net.forward(x[own.index])
            out.append(pd.DataFrame({"t": t, "ticker": own["ticker"].to_numpy(), "mu": mu, "scale": scale}))
        return pd.concat(out)

    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(run, "t long, ticker string, mu double, scale double")
