"""The stateful backtest: stops, buy-backs, refill and slots, one pass over the sessions of each run.

A position's fate depends on the days before, so each run (market, strategy, book size, settings) is one group; what
goes in is the bars of the tickers that were ever wanted and the target lists, not the whole panel. Runs are independent
and spread over the cluster; a run's rows are bounded by sessions times tickers ever wanted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    k: int = 5
    rebalance: int = 21
    warmup: int = 260
    capsd: float = 1.5
    capmax: float = 0.03
    maxdays: int = 260
    stop: float = 0.0
    psar: bool = False
    psarstep: float = 0.02
    psarmax: float = 0.2
    psarvol: float = 0.0
    vstop: float = 0.0
    rebuy: float = -1.0
    rebuystop: float = 0.0
    refill: bool = False
    stopmedian: bool = False


@dataclass
class Position:
    """An open position: its mark, entry and stop state."""

    entry: float
    mark: float
    since: int
    rank: int
    level: float = 0.0
    extreme: float = 0.0
    factor: float = 0.0
    band: float = 0.0
    high_close: float = 0.0
    sure: float = 0.0
    exit_next: bool = False


@dataclass
class Stopped:
    """A stopped ticker that is still wanted: where it may be bought back."""

    level: float
    falling: float
    extreme: float
    factor: float
    turned: bool = False
    day: int = 0


@dataclass
class Book:
    """The state of a run."""

    settings: Settings
    open: dict[str, Position] = field(default_factory=dict)
    stopped: dict[str, Stopped] = field(default_factory=dict)
    trades: list[tuple] = field(default_factory=list)
    orders: list[tuple] = field(default_factory=list)


def _ok(x: float) -> bool:
    return np.isfinite(x) and x > 0


def _band(multiple: float, sigma: float) -> float:
    return float(np.clip(multiple * (sigma if _ok(sigma) else 0.02), 0.02, 0.5))


class Run:
    """One run over arrays by session and ticker: o, h, l, c, cf and sigma."""

    def __init__(self, s: Settings, tickers: list[str], data: dict[str, np.ndarray], wanted: dict[int, list[str]]) -> None:
        self.s, self.tickers, self.x, self.wanted = s, tickers, data, wanted
        self.at = {t: i for i, t in enumerate(tickers)}
        self.book = Book(s)
        self.sessions = len(data["cf"])

    def value(self, name: str, t: int, ticker: str) -> float:
        return float(self.x[name][t, self.at[ticker]]) if 0 <= t < self.sessions else float("nan")

    def _lowest(self, ticker: str, first: int, last: int) -> float:
        own = self.x["l"][max(0, first) : last + 1, self.at[ticker]]
        own = own[np.isfinite(own)]
        return float(own.min()) if len(own) else float("nan")

    def _highest(self, ticker: str, first: int, last: int) -> float:
        own = self.x["h"][max(0, first) : last + 1, self.at[ticker]]
        own = own[np.isfinite(own)]
        return float(own.max()) if len(own) else float("nan")

    # ---- stops

    def _arm(self, p: Position, ticker: str, u: int) -> None:
        """Stop levels of a position that is opened on day u."""
        s, sigma = self.s, self.value("sigma", u - 1, ticker)
        if s.psar or s.psarvol:
            p.factor, p.extreme = s.psarstep, p.entry
            if s.psarvol:
                p.band = _band(s.psarvol, sigma)
                p.level = p.entry * (1 - p.band)
            else:
                low = self._lowest(ticker, u - 5, u - 1)
                p.level = low if np.isfinite(low) and low < p.entry else 0.95 * p.entry
        elif s.vstop:
            p.band = _band(s.vstop, sigma)
            p.level, p.sure, p.high_close = p.entry * (1 - p.band), p.entry * (1 - 1.5 * p.band), p.entry
        elif s.stop:
            p.level = p.entry * (1 - s.stop)

    def _stopped_at(self, p: Position, ticker: str, u: int) -> float | None:
        """The price at which day u's stop sells, or None; a surviving day moves the levels."""
        s = self.s
        o, h, low, c = (self.value(n, u, ticker) for n in ("o", "h", "l", "c"))
        if not _ok(low):
            return None
        if s.psar or s.psarvol:
            if low <= p.level:
                return min(o, p.level) if _ok(o) else p.level
            if _ok(h):
                if h > p.extreme:
                    p.extreme, p.factor = h, min(s.psarmax, p.factor + s.psarstep)
                nxt = min(p.level + p.factor * (p.extreme - p.level), self._lowest(ticker, u - 1, u))
                if p.band and _ok(c):
                    nxt = min(nxt, c * (1 - p.band))
                p.level = max(p.level, nxt)
            return None
        if s.vstop:
            if low <= p.sure:
                return min(o, p.sure) if _ok(o) else p.sure
            if _ok(c):
                if c < p.level:
                    p.exit_next = True
                else:
                    p.high_close = max(p.high_close, c)
                    p.level = max(p.level, p.high_close * (1 - p.band))
                    p.sure = max(p.sure, p.level * (1 - 0.5 * p.band))
            return None
        if s.stop and low <= p.level:
            return min(o, p.level) if _ok(o) else p.level
        return None

    def _sell(self, ticker: str, u: int, price: float, why: str) -> float:
        p = self.book.open.pop(ticker)
        self.book.trades.append((ticker, p.rank, p.since, u, p.entry, price, price / p.entry - 1, why))
        return price / p.mark - 1

    def _forget_or_remember(self, ticker: str, p: Position, u: int) -> None:
        level = max(p.extreme, p.level) if self.s.psar or self.s.psarvol else p.level
        self.book.stopped[ticker] = Stopped(p.level, level, p.level, self.s.psarstep, day=u)

    def _fall(self, u: int) -> None:
        """Falling levels of stopped tickers through day u."""
        if not (self.s.psar or self.s.psarvol):
            return
        for ticker, st in self.book.stopped.items():
            c, low = self.value("c", u, ticker), self.value("l", u, ticker)
            if st.turned or not _ok(low) or st.day == u:
                continue
            if _ok(c) and c > st.falling:
                st.turned = True
                continue
            if low < st.extreme:
                st.extreme, st.factor = low, min(self.s.psarmax, st.factor + self.s.psarstep)
            moved = max(st.falling + st.factor * (st.extreme - st.falling), self._highest(ticker, u - 1, u))
            st.falling = min(st.falling, moved)

    def _may_buy(self, ticker: str, t: int) -> bool:
        st, s = self.book.stopped.get(ticker), self.s
        if st is None:
            return True
        if s.rebuystop or s.rebuy < 0:
            return False
        if s.psar or s.psarvol:
            return st.turned
        cf = self.value("cf", t, ticker)
        return _ok(cf) and cf >= st.level * (1 + s.rebuy)

    def _buy(self, ticker: str, u: int, price: float, rank: int, within: bool = False, after_stop: bool = False) -> float:
        """Opens a position. Bought ``within`` the day, a stop that day sells at its level; bought back ``after_stop`` on that day, none does."""
        cf = self.value("cf", u, ticker)
        p = Position(price, cf if _ok(cf) else price, u, rank)
        self._arm(p, ticker, u)
        self.book.open[ticker] = p
        self.book.stopped.pop(ticker, None)
        line = p.sure if self.s.vstop else p.level
        sold = None if after_stop else self._stopped_at(p, ticker, u)
        if sold is not None:
            sold = line if within else sold
            p.mark = price
            self._forget_or_remember(ticker, p, u)
            return self._sell(ticker, u, sold, "stop")
        return p.mark / price - 1

    def _trigger(self, ticker: str) -> float:
        return self.book.stopped[ticker].level * (1 + self.s.rebuystop)

    def _back_today(self, ticker: str, u: int, target: list[str]) -> float:
        """A ticker that was stopped today and closed over its buy-back's trigger is bought there after the stop."""
        cf = self.value("cf", u, ticker)
        if not (self.s.rebuystop and ticker in self.book.stopped and ticker not in self.book.open and _ok(cf) and cf >= self._trigger(ticker)):
            return 0.0
        price, rank = self._trigger(ticker), target.index(ticker) if ticker in target else len(target)
        self._log(u - 1, ticker, rank, price, price)
        return self._buy(ticker, u, price, rank, after_stop=True)

    def _log(self, t: int, ticker: str, rank: int, limit: float, entry: float | None) -> None:
        self.book.orders.append((ticker, rank, t, limit, entry is not None, entry))

    def _distance(self, t: int, ticker: str) -> float:
        """How far under the last close the stop of a new position would start."""
        cf, s = self.value("cf", t, ticker), self.s
        if not _ok(cf) or not (s.stop or s.psar or s.psarvol or s.vstop):
            return 0.0
        p = Position(cf, cf, t + 1, 0)
        self._arm(p, ticker, t + 1)
        return 1 - p.level / cf if p.level > 0 else 0.0

    def _widest(self, t: int, tickers: list[str]) -> float:
        """The upper median of the candidates' distances, which a new position's may not exceed; no limit without ``stopmedian``."""
        if not self.s.stopmedian or not tickers:
            return float("inf")
        found = sorted(self._distance(t, x) for x in tickers)
        return found[len(found) // 2]

    # ---- days

    def day(self, t: int, target: list[str], reserve: list[str]) -> float:
        """Trades of day t + 1 on what is known after t; returns the book's return."""
        s, book, u, total = self.s, self.book, t + 1, 0.0
        keep = set(target) | (set(reserve) if s.refill else set())
        for ticker in sorted(book.open):
            p, o = book.open[ticker], self.value("o", u, ticker)
            if p.exit_next and _ok(o):
                self._forget_or_remember(ticker, p, u)
                total += self._sell(ticker, u, o, "stop")
            elif ticker not in keep and _ok(o):
                total += self._sell(ticker, u, o, "dropped")
            elif (price := self._stopped_at(p, ticker, u)) is not None:
                self._forget_or_remember(ticker, p, u)
                total += self._sell(ticker, u, price, "stop")
                total += self._back_today(ticker, u, target)
            else:
                cf = self.value("cf", u, ticker)
                if _ok(cf):
                    total += cf / p.mark - 1
                    p.mark = cf
                if u - p.since + 1 >= s.maxdays:
                    self._sell(ticker, u, p.mark, "days")
        for ticker in [x for x in book.stopped if x not in keep]:
            del book.stopped[ticker]
        if s.rebuystop:
            for ticker in sorted(x for x, st in book.stopped.items() if st.day < u):
                if len(book.open) >= s.k:
                    break
                trigger, o, h = self._trigger(ticker), self.value("o", u, ticker), self.value("h", u, ticker)
                if _ok(o) and o >= trigger or _ok(h) and h >= trigger:
                    at_open = _ok(o) and o >= trigger
                    price, rank = o if at_open else trigger, target.index(ticker) if ticker in target else len(target)
                    self._log(t, ticker, rank, price, price)
                    total += self._buy(ticker, u, price, rank, within=not at_open)
        free, again = s.k - len(book.open), []
        widest = self._widest(t, target + reserve)
        for rank, ticker in enumerate(target + (reserve if s.refill else [])):
            if free <= 0:
                break
            if ticker in book.open or not self._may_buy(ticker, t) or self._distance(t, ticker) > widest:
                continue
            sigma, cf, o = self.value("sigma", t, ticker), self.value("cf", t, ticker), self.value("o", u, ticker)
            limit = cf * (1 + min(s.capmax, s.capsd * (sigma if _ok(sigma) else 0.02)))
            filled = _ok(o) and o <= limit
            self._log(t, ticker, rank, limit, o if filled else None)
            if filled:
                total += self._buy(ticker, u, o, rank)
                free -= 1
                if ticker in book.stopped:
                    again.append(ticker)
        for ticker in again:
            total += self._back_today(ticker, u, target)
        self._fall(u)
        return total / s.k

    def all_days(self) -> list[tuple[int, float]]:
        target: list[str] = []
        reserve: list[str] = []
        out = []
        for t in range(self.s.warmup, self.sessions - 1):
            if (t - self.s.warmup) % self.s.rebalance == 0:
                own = self.wanted.get(t, [])
                target, reserve = own[: self.s.k], own[self.s.k : 2 * self.s.k]
            out.append((t + 1, self.day(t, target, reserve)))
        for ticker, p in sorted(self.book.open.items()):
            self.book.trades.append((ticker, p.rank, p.since, -1, p.entry, p.mark, p.mark / p.entry - 1, "open"))
        return out


def _inputs(panel: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Bars of the tickers ever among the first 2k, with their rank where they have one."""
    wanted = ranked.where(F.col("rank") < 2 * k).select("t", "ticker", "rank")
    bars = panel.join(wanted.select("ticker").distinct(), "ticker", "left_semi").select("t", "ticker", "o", "h", "l", "c", "cf", "sigma")
    return bars.join(wanted, ["t", "ticker"], "left")


def _run(rows: pd.DataFrame, s: Settings) -> tuple[Run, list[tuple[int, float]]]:
    tickers = sorted(rows["ticker"].unique())
    n = int(rows["t"].max()) + 1
    col = rows["ticker"].map({t: i for i, t in enumerate(tickers)}).to_numpy()
    data = {}
    for name in ("o", "h", "l", "c", "cf", "sigma"):
        data[name] = np.full((n, len(tickers)), np.nan)
        data[name][rows["t"].to_numpy(), col] = rows[name].to_numpy(dtype=float)
    wanted: dict[int, list[str]] = {}
    for r in rows[rows["rank"].notna()].sort_values(["t", "rank"]).itertuples():
        wanted.setdefault(int(r.t), []).append(r.ticker)
    run = Run(s, tickers, data, wanted)
    return run, run.all_days()


def backtests(panel: DataFrame, ranked: DataFrame, runs: dict[str, Settings], what: str = "daily") -> DataFrame:
    """Daily returns (run, u, ret), trades (run, ticker, rank, opened, closed, entry, exit, ret, why) or orders of each run.

    closed is null for a position that is still open; it is marked at its last close. Orders (run, ticker, rank, t, limit,
    filled, entry) are all that were placed, those that didn't fill with a null entry.
    """
    k = max(s.k for s in runs.values())
    rows = _inputs(panel, ranked, k).withColumn("run", F.explode(F.array(*map(F.lit, runs))))

    def daily(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, days = _run(pdf, runs[key[0]])
        return pd.DataFrame({"run": key[0], "u": [u for u, _ in days], "ret": [r for _, r in days]})

    def trades(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run, _ = _run(pdf, runs[key[0]])
        out = pd.DataFrame(run.book.trades, columns=["ticker", "rank", "opened", "closed", "entry", "exit", "ret", "why"])
        return out.assign(run=key[0], closed=out["closed"].where(out["closed"] >= 0).astype("Int64"))[["run", "ticker", "rank", "opened", "closed", "entry", "exit", "ret", "why"]]

    def orders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run, _ = _run(pdf, runs[key[0]])
        out = pd.DataFrame(run.book.orders, columns=["ticker", "rank", "t", "limit", "filled", "entry"])
        return out.assign(run=key[0], entry=out["entry"].astype(float))[["run", "ticker", "rank", "t", "limit", "filled", "entry"]]

    if what == "orders":
        return rows.groupBy("run").applyInPandas(orders, "run string, ticker string, rank long, t long, limit double, filled boolean, entry double")
    if what == "daily":
        return rows.groupBy("run").applyInPandas(daily, "run string, u long, ret double")
    return rows.groupBy("run").applyInPandas(trades, "run string, ticker string, rank long, opened long, closed long, entry double, exit double, ret double, why string")
