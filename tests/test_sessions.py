"""Same-day buy-backs, stop medians, order logs, stateful streams against plain loops, regimes, stores and HTTP lists."""

import http.server
import threading

import numpy as np
import pandas as pd
import pytest

from barloom.operators import backtest, ingest, models, montecarlo
from barloom.sources import bars as source
from barloom.sources import http as lists
from barloom.streaming import events


def run(settings, wanted=None, **rows):
    n = len(rows["c"])
    x = {k: np.array(rows.get(k, rows["c"]), float)[:, None] for k in ("o", "h", "l", "c")}
    x |= {"cf": np.array(rows["c"], float)[:, None], "sigma": np.full((n, 1), 0.02)}
    r = backtest.Run(settings, ["A"], x, wanted or {0: ["A"]})
    return r, dict(r.all_days())


def test_bought_back_on_the_day_of_the_stop():
    s = backtest.Settings(k=1, warmup=0, rebalance=100, stop=0.05, rebuystop=0.01, capmax=0.5, capsd=99)
    # bought at 100, stopped at 95 on a day that closes at 99, over the trigger 95.95: bought there again
    r, days = run(s, c=[100, 100, 99, 99], l=[100, 100, 90, 99], o=[100, 100, 100, 99])
    assert r.book.trades[0][4:8] == (100, 95, pytest.approx(-0.05), "stop")
    assert r.book.open["A"].entry == pytest.approx(95.95) and days[2] == pytest.approx(95 / 100 - 1 + 99 / 95.95 - 1)
    # a close under the trigger waits; a later high reaches it within the day
    r, days = run(s, c=[100, 100, 94, 97], l=[100, 100, 90, 94], o=[100, 100, 100, 94], h=[100, 100, 100, 98])
    assert r.book.open["A"].entry == pytest.approx(95.95) and days[3] == pytest.approx(97 / 95.95 - 1)


def test_bought_within_the_day_and_stopped_at_the_level():
    s = backtest.Settings(k=1, warmup=0, rebalance=100, stop=0.05, rebuystop=0.01, capmax=0.5, capsd=99)
    r, days = run(s, c=[100, 100, 94, 88], l=[100, 100, 90, 85], o=[100, 100, 100, 80], h=[100, 100, 100, 97])
    back = r.book.trades[1]
    assert back[4] == pytest.approx(95.95) and back[5] == pytest.approx(95.95 * 0.95)


def test_stop_on_the_day_of_the_purchase_is_bought_back_after_it():
    s = backtest.Settings(k=1, warmup=0, rebalance=100, stop=0.05, rebuystop=0.01, capmax=0.5, capsd=99)
    r, days = run(s, c=[100, 99], l=[100, 90], o=[100, 100])
    assert [t[7] for t in r.book.trades][:1] == ["stop"] and r.book.trades[-1][4] == pytest.approx(95.95)
    assert days[1] == pytest.approx(-0.05 + 99 / 95.95 - 1)


def test_unfilled_orders_are_logged():
    s = backtest.Settings(k=1, warmup=0, rebalance=100, capmax=0.01)
    r, _ = run(s, c=[100, 110, 110], o=[100, 110, 110.5])
    assert r.book.orders == [("A", 0, 0, pytest.approx(101.0), False, None), ("A", 0, 1, pytest.approx(111.1), True, 110.5)]


def test_stop_median_leaves_the_widest_out():
    s = backtest.Settings(k=3, warmup=0, rebalance=100, psarvol=3.0, stopmedian=True, capmax=0.5, capsd=99)
    c = np.full((3, 3), 100.0)
    x = {k: c.copy() for k in ("o", "h", "l", "c", "cf")} | {"sigma": np.tile([0.01, 0.02, 0.05], (3, 1))}
    r = backtest.Run(s, ["A", "B", "C"], x, {0: ["A", "B", "C"]})
    r.all_days()
    assert set(r.book.open) == {"A", "B"}
    assert r._distance(0, "C") == pytest.approx(0.15)


def stream(spark, tmp_path, rows):
    for i in range(3):
        spark.createDataFrame(rows[i::3].sort_values("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    return events.read(spark, str(tmp_path / "e"), files=100)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def made(n=400):
    rng = np.random.default_rng(6)
    kinds = np.array(["purchase", "click", "view", "error", "signup"])
    return pd.DataFrame({"event_id": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="17min"), "user_id": rng.integers(0, 5, n), "event_type": kinds[rng.integers(0, 5, n)], "value": rng.uniform(10, 100, n)})


def test_guarded_positions_equal_a_loop(spark, tmp_path, rocks):
    rows = made()
    got = events.drained(events.guarded(stream(spark, tmp_path, rows), "purchase", 0.4, 1.0, 0.25)).toPandas()
    for mode in ("fixed", "trail", "breakeven"):
        want, paid, high = [], {}, {}
        for r in rows.itertuples():
            own = paid.setdefault(r.user_id, [])
            if r.event_type == "purchase":
                high[r.user_id] = max(high[r.user_id], r.value) if own else r.value
                own.append(r.value)
            elif own:
                entry, top = sum(own) / len(own), high[r.user_id]
                stop = {"fixed": 0.6 * entry, "trail": 0.6 * top, "breakeven": entry if top >= 1.25 * entry else 0.6 * entry}[mode]
                if r.value <= stop or r.value >= 2 * entry:
                    want.append((r.event_id, "stop" if r.value <= stop else "take"))
                    own.clear()
                else:
                    high[r.user_id] = max(top, r.value)
        own = got[got["mode"] == mode]
        assert sorted(zip(own["event_id"], own["why"])) == want


def test_slots_cap_equals_a_loop(spark, tmp_path, rocks):
    rows = made()
    got = sorted((str(r.day), r.user_id) for r in events.drained(events.slots_cap(stream(spark, tmp_path, rows), 3, "click", "purchase")).collect())
    want = []
    for day, own in rows.groupby(rows["ts"].dt.date):
        ordered, bought = set(), set()
        for r in own.itertuples():
            if r.event_type == "click":
                ordered.add(r.user_id)
            elif r.event_type == "purchase":
                bought.add(r.user_id)
            if len(bought) >= 3:
                want += [(str(day), u) for u in ordered - bought]
                break
    assert got == sorted(want) and want


def test_holds_go_through_their_states(spark, tmp_path, rocks):
    kinds = {"signup": "order", "purchase": "fill", "view": "close", "error": "price", "click": "price"}
    got = events.drained(events.holds(stream(spark, tmp_path, made()), kinds, 0.3, 0.5, 0.1, 5)).toPandas().sort_values("event_id")
    assert set(got["why"]) >= {"placed", "filled", "unfilled", "stop", "bought back", "strength"}
    for _, own in got.groupby("user_id"):
        assert (own["was"].iloc[1:].to_numpy() == own["state"].iloc[:-1].to_numpy()).all()
        bought = None
        for r in own.itertuples():
            if r.why in ("filled", "bought back"):
                bought = r.price
            elif r.why == "stop":
                assert r.price <= 0.7 * bought
            elif r.why == "strength":
                assert r.price >= 1.5 * bought


def test_days_drawn_in_states():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.005, 200), rng.normal(0, 0.03, 200), rng.normal(0, 0.005, 200)]
    fit = models.fit_regime(x, 2)
    days = montecarlo.drawn_in_states(700, np.arange(300), 10, fit)
    assert days.shape == (300, 10) and days.min() >= 101 and days.max() <= 700
    assert (montecarlo.drawn_in_states(700, np.array([7]), 10, fit) == days[7]).all()
    wild = (days >= 301) & (days < 501)
    assert fit["now"][0] > 0.9 and wild[:, 0].mean() < 0.15  # paths start in the calm state, which the last days are in
    again = models.fit_regime(x, 2, rounds=1, warm=fit)
    assert again["loglik"] == pytest.approx(fit["loglik"], abs=1.0)


def test_mixed_volatility_falls_back(spark):
    by_state = spark.createDataFrame([(1, "A", 0, 50.0, 0.01), (1, "A", 1, 10.0, 0.05)], "t0 long, ticker string, state int, weight double, sigma double")
    overall = spark.createDataFrame([(1, "A", 100, 0.02), (1, "B", 30, 0.03)], "t0 long, ticker string, n long, sigma double")
    fits = spark.createDataFrame([(1, [0.5, 0.5])], "t0 long, ahead array<double>")
    got = {r.ticker: r.sigma for r in montecarlo.ahead_volatility(by_state, overall, fits).collect()}
    assert got["A"] == pytest.approx(np.sqrt(0.5 * 0.01**2 + 0.5 * 0.02**2)) and got["B"] == 0.03


def test_store_round_trip_and_prune(spark, tmp_path):
    rows = spark.sql("select date'2024-01-02' d, 'AB C' ticker, 1.0 o, 2.0 h, 0.5 l, 1.5 c, 10.0 v union all select date'2024-01-03', 'X', 1.0, 2.0, 0.5, 1.5, 0.0").selectExpr("d", "ticker", *(f"cast({c} as double) {c}" for c in "ohlcv"))
    source.save_store(rows, str(tmp_path / "s"))
    back = source.read_store(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("d", "ticker", *"ohlcv").collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "f").mkdir()
    for d in ("2024-01-01", "2024-01-02", "2024-01-03"):
        (tmp_path / "f" / f"{d}.json").write_text("[]")
    assert source.newest(spark, str(tmp_path / "f"), 2) == ["2024-01-03.json", "2024-01-02.json"]
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.suffix == ".json") == ["2024-01-02.json", "2024-01-03.json"]


class Answers(http.server.BaseHTTPRequestHandler):
    left = {"/busy": 2}

    def do_GET(self):
        bad = self.left.get(self.path, 0) > 0
        if bad:
            self.left[self.path] -= 1
        self.send_response(429 if bad else 404 if self.path == "/none" else 200)
        self.end_headers()
        self.wfile.write(b'["x"]')

    def log_message(self, *a):
        pass


def test_http_lists_are_tried_again_and_kept(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        waits = []
        assert lists.fetch(f"{at}/busy", wait=1.0, sleep=waits.append) == (200, '["x"]') and waits == [1.0, 2.0]
        assert lists.fetch("http://127.0.0.1:1/x", tries=2, wait=0.0)[0] == 0
        got = {r.url.rpartition("/")[2]: r.status for r in lists.lists(spark, [f"{at}/a", f"{at}/none"], wait=0.01).collect()}
        assert got == {"a": 200, "none": 404}
        folder = str(tmp_path / "c")
        assert lists.cached(spark, f"{at}/a", folder, "2024-01-02").first()[0].strip() == '["x"]'
        assert lists.cached(spark, "http://127.0.0.1:1/x", folder, "2024-01-03", tries=1).first()[0].strip() == '["x"]'
        assert lists.newest_days(spark, folder) == ["2024-01-02"]
        with pytest.raises(FileNotFoundError):
            lists.cached(spark, f"{at}/a", str(tmp_path / "none"), "2024-01-01", offline=True)
    finally:
        server.shutdown()


def test_cross_rates_need_their_pairs(spark):
    rates = lambda *rows: {r.currency: r.rate for r in ingest.cross_rates(spark.createDataFrame(rows, "pair string, rate double")).collect()}
    assert rates(("EURGBP", 0.8), ("GBPUSD", 1.25), ("EURAUD", 1.6)) == {"EUR": 1.0, "GBP": 0.8, "USD": 1.0, "AUD": 1.6}
    assert rates(("GBPUSD", 1.25), ("EURAUD", -1.0)) == {"EUR": 1.0}


def rel(**rows):
    return {k: np.array(rows.get(k, rows["c"]), float) for k in ("o", "h", "l", "c")}


def test_simulated_slot_buys_back_and_may_start_held():
    s = backtest.Settings(stop=0.05, rebuystop=0.01, capmax=0.5, capsd=99)
    # bought at 1, stopped at 0.95 on a day that closes at 0.99: bought back at 0.9595 that day
    ret, stopped = montecarlo.slot(rel(c=[1.0, 0.99], l=[1.0, 0.9]), np.array([0, 1]), s, 0.02)
    assert stopped and ret == pytest.approx(0.95 * 0.99 / 0.9595 - 1)
    # a later day's high reaches the trigger
    ret, _ = montecarlo.slot(rel(c=[1.0, 0.92, 1.05], l=[1.0, 0.9, 1.0], h=[1.0, 1.0, 1.06], o=[1, 1, 1]), np.array([0, 1, 2]), s, 0.02)
    assert ret == pytest.approx(0.95 * (0.92 * 1.05) / 0.9595 - 1)
    # held from the start, sold at its own level
    ret, stopped = montecarlo.slot(rel(c=[0.97], l=[0.9]), np.array([0]), backtest.Settings(stop=0.5), 0.02, held_from=0.96)
    assert stopped and ret == pytest.approx(-0.04)
    # half the moves
    ret, _ = montecarlo.slot(rel(c=[1.0, 1.21]), np.array([0, 1]), backtest.Settings(capmax=0.5, capsd=99), 0.02, calm=0.5)
    assert ret == pytest.approx(0.1)


def test_net_steps_down_the_crps():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 17))
    sd = np.full(2000, 0.01)
    y = 0.001 * np.tanh(x[:, 0]) + rng.normal(0, 0.01, 2000)
    net = models.Net()
    losses = net.train(x, y, sd, 30)
    assert losses[-1] < losses[0]
    # the loss is the CRPS: the mean distance of draws to y less half that between draws
    _, mu, scale = net.forward(x[:1])
    draws = mu[0] + scale[0] * sd[0] * np.random.default_rng(3).normal(size=40_000)
    again = models.Net()
    again.w = [w.copy() for w in net.w]
    assert again.step(x[:1], y[:1], sd[:1]) == pytest.approx(models.crps(draws, y[0]) / sd[0], rel=0.03)


def test_lists_that_shrink_and_pages_that_repeat(spark):
    old, new = spark.range(400).withColumnRenamed("id", "x"), spark.range(1000, 1310).withColumnRenamed("id", "x")
    assert ingest.kept_list(old, new).count() == 400 and ingest.kept_list(old, spark.range(1000, 1400).withColumnRenamed("id", "x")).where("x < 1000").count() == 0
    pages = spark.createDataFrame([(0, "[AA] [BB]"), (1, "[BB] [CC]"), (2, "[AA]"), (3, "[DD]")], "page int, html string")
    assert sorted(r.code for r in ingest.pages_until_old(pages, r"\[([A-Z]+)\]").collect()) == ["AA", "BB", "CC"]


def test_export_of_an_exchange(spark):
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in range(1, 29)]
    rows = []
    for i, d in enumerate(days):
        k = 2.0 if i < 40 else 1.0  # a two-for-one split, with volumes
        rows.append((d, "SPL", 50.0 * k, 51.0 * k, 49.0 * k, 50.0 * k, 1000.0 / k))
        rows.append((d, "OK", 10.0, 10.2, 9.9, 10.0 + i % 3 * 0.1, 5000.0))
        rows.append((d, "JMP", 10.0 * (5.7 if i > 50 else 1), 11.0 * (5.7 if i > 50 else 1), 9.0 * (5.7 if i > 50 else 1), 10.0 * (5.7 if i > 50 else 1), 9000.0))
        rows.append((d, "FND", 10.0, 10.0, 10.0, 10.0, 9e9))
        rows.append((d, "LOW", 1.0, 1.0, 1.0, 1.0, 1.0))
    bars = spark.createDataFrame(rows, "d string, ticker string, o double, h double, l double, c double, v double").withColumn("d", __import__("pyspark.sql.functions", fromlist=["to_date"]).to_date("d"))
    shares = spark.createDataFrame([(t, t, "ETF" if t == "FND" else "EQ") for t in ("SPL", "OK", "JMP", "FND", "LOW")], "ticker string, name string, kind string")
    out = ingest.export_shares(bars, shares, 2).toPandas()
    assert set(out["ticker"]) == {"SPL", "OK"} and len(out) == 2 * len(days)
    assert out[out["ticker"] == "SPL"]["c"].unique() == pytest.approx([50.0])
