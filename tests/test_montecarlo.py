import numpy as np
import pytest

from barloom.operators import montecarlo as M
from barloom.operators import panel
from barloom.operators.backtest import Settings
from barloom.sources import bars as source


def test_draws_stay_in_the_window_and_repeat():
    a = M.drawn(900, np.arange(50), 21)
    assert a.shape == (50, 21) and a.min() >= 151 and a.max() <= 900
    assert (np.diff(a[:, :5], axis=1) <= 1).all() and np.array_equal(a[10:20], M.drawn(900, np.arange(10, 20), 21))
    assert M.drawn(900, np.arange(50), 21, skip=100).max() <= 800 and M.drawn(3, np.arange(2), 21).shape == (2, 0)


def _rel(c, o=None, low=None, high=None):
    c = np.array(c, float)
    pick = lambda x: c if x is None else np.array(x, float)
    return {"o": pick(o), "h": pick(high), "l": pick(low), "c": c}


def test_slot_without_stops_is_a_product():
    rel = _rel([1.0, 1.01, 0.98, np.nan, 1.03])
    ret, stopped = M.slot(rel, np.array([0, 1, 2, 3, 4]), Settings(), 0.02)
    assert ret == pytest.approx(1.01 * 0.98 * 1.03 - 1) and not stopped


def test_slot_stops_and_limit():
    ret, stopped = M.slot(_rel([1.0, 0.9, 1.2], low=[1.0, 0.9, 1.0]), np.arange(3), Settings(stop=0.05), 0.02)
    assert stopped and ret == pytest.approx(-0.1)
    ret, stopped = M.slot(_rel([1.2, 1.0], o=[1.2, 1.0]), np.arange(2), Settings(), 0.02)
    assert ret == pytest.approx(0.0) and not stopped


def test_simulation_is_the_same_for_any_chunk(spark):
    market = source.synthetic(spark, tickers=5, sessions=420)
    p = panel.with_market(panel.tradable(panel.features(market))).cache()
    cands = spark.createDataFrame([(350, "S00"), (350, "S01"), (400, "S02")], "t0 long, ticker string")
    s = Settings(psarvol=3.0)
    one = {(r.t0, r.path, r.ticker): r.ret for r in M.simulate(p, cands, s, paths=12, window=200).collect()}
    two = {(r.t0, r.path, r.ticker): r.ret for r in M.simulate(p, cands, s, paths=12, window=200, chunk=5).collect()}
    assert one == two and len(one) == 36
    cut = {(r.t0, r.path, r.ticker): r.ret for r in M.simulate(p.where("t <= 400"), cands, s, paths=12, window=200).collect()}
    assert cut == one


def test_choices(spark):
    rows = [(1, p, t, r) for p in range(4) for t, r in (("A", 0.1), ("B", 0.2), ("C", 0.2 if p else -0.9))]
    paths = spark.createDataFrame(rows, "t0 long, path long, ticker string, ret double")
    assert [r.ticker for r in M.chosen(paths, 2).orderBy("place").collect()] == ["B", "A"]
    assert [r.ticker for r in M.chosen(paths, 2, by_growth=True).orderBy("place").collect()] == ["B", "A"]
    res = spark.createDataFrame([(1, "A", 0, 0.1), (1, "A", 1, 0.3), (1, "B", 0, 0.2), (1, "B", 1, 0.2), (1, "C", 1, 0.0), (1, "C", 0, 0.5)], "t0 long, ticker string, setting int, ret double")
    best = M.best_settings(res)
    assert {r.ticker: r.setting for r in best.collect()} == {"A": 1, "B": 0, "C": 0} and M.voted(best).first().setting == 0
    record = spark.createDataFrame([(i, 0.01) for i in range(5)] + [(i, -0.05) for i in range(5, 9)], "t0 long, edge double")
    on = {r.t0: r.on for r in M.gated(record).collect()}
    assert not on[0] and not on[1] and on[4] and not on[8]


def test_state_volatility(spark):
    p = spark.createDataFrame([(t, "A", x) for t, x in enumerate([0.1, -0.1, 0.5, -0.5])], "t long, ticker string, ret double")
    g = spark.createDataFrame([(9, t, [1.0, 0.0] if t < 2 else [0.0, 1.0]) for t in range(4)], "t0 long, t long, g array<double>")
    got = {r.state: r.sigma for r in M.state_volatility(p, g, 2).collect()}
    assert got[0] == pytest.approx(0.1) and got[1] == pytest.approx(0.5)


def test_net_samples_dont_look_ahead(spark):
    from barloom.operators import neural

    market = source.synthetic(spark, tickers=6, sessions=480)
    p = panel.with_market(panel.tradable(panel.features(market))).cache()
    full = {(r.t, r.ticker): r for r in neural.samples(p).collect()}
    part = neural.samples(p.where("t < 420")).collect()
    assert part and all(list(full[r.t, r.ticker].x) == list(r.x) and len(r.x) == 17 for r in part)
    assert all(r.ready == r.t + 21 for r in part)
    out = neural.walk_forward(neural.samples(p)).collect()
    assert len(out) == len(full) and all(abs(r.mu) <= 0.002 and r.scale > 0 for r in out)
