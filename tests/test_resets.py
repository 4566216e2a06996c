"""The simulations cover every reset of the ranking, with the survey's 500 paths each."""

import numpy as np
import pytest

import __spark_entry__
from barloom.plans import evaluation_queries as E
from barloom.plans import stream_queries as Q

SF = __spark_entry__.SMOKE_DIR


@pytest.fixture(scope="module")
def resets(spark):
    return {r.t for r in E.ranking(spark, SF, "momentum").select("t").distinct().collect()}


def test_every_reset_is_drawn_as_by_hand(spark, resets):
    got = E.bootstrap_days(spark, SF).toPandas()
    assert set(got["t0"]) == resets and len(got) == len(resets) * 500 * 21
    m = 2**31
    for t0, path in ((min(resets), 0), (max(resets), 499)):
        low, want = max(1, t0 - 749), []
        for b in range(5):
            h = (7919 + t0 * 112648 + path * 217377 + b * 322106) % m
            for _ in range(2):
                h = (h * 1103515245 + 12345) % m
            start = low + (h // 65536) % (t0 + 1 - low - 4)
            want += [min(t0, start + i) for i in range(5)]
        own = got[(got["t0"] == t0) & (got["path"] == path)].sort_values("j")
        assert own["q"].tolist() == want[:21]


def test_quantiles_and_calibration_have_every_reset(spark, resets):
    book = E._book(spark, SF).toPandas()
    got = E.mc_quantiles(spark, SF).toPandas().set_index("t0")
    assert set(got.index) == resets and (book.groupby("t0").size() == 500).all()
    for t0, own in book.groupby("t0")["ret"]:
        assert got.loc[t0, ["p5", "p50", "p95"]].tolist() == pytest.approx(np.quantile(own, [0.05, 0.5, 0.95]).tolist(), abs=1e-7)
    assert E.mc_calibration(spark, SF).first().resets == len(resets)


def test_stops_have_every_reset(spark, resets):
    got = Q.mc_stops(spark, SF).toPandas()
    assert set(got["t0"]) == resets and (got.groupby(["t0", "ticker"]).size() == 500).all()
    asked = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Q.models, "regimes", lambda market, t0: asked.append((market, t0)))
        Q.regimes(spark, SF)
    market, t0 = asked[0]
    assert {r.t0 for r in t0.collect()} == resets and market.where(f"t <= {min(resets)}").count() > 20
