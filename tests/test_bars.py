"""Hand-made cases of the bar engine, and properties that must hold for any feature."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import clean, costs, evaluate, indicators, panel, simulate, strategies
from barloom.sources import bars as source

DAY = dt.date(2020, 1, 1)
BARS = source.BARS


def day(t):
    return DAY + dt.timedelta(days=t)


def series(spark, points, ticker="A"):
    """Flat bars of one close each, at sessions t; a second ticker keeps every session in the calendar."""
    rows = [(day(t), ticker, c, c, c, c, 1.0) for t, c in points]
    rows += [(day(t), "ZZ", 1.0, 1.0, 1.0, 1.0, 1.0) for t in range(max(t for t, _ in points) + 1)]
    return spark.createDataFrame(rows, BARS)


def column(df, name, ticker="A"):
    return {r.t: r[name] for r in df.where(F.col("ticker") == ticker).collect()}


def test_carry_forward_and_return_over_a_gap(spark):
    p = panel.log_return(panel.carry_forward(panel.dense(series(spark, [(0, 10.0), (1, 11.0), (8, 22.0), (9, 22.0)]))))
    cf, ret = column(p, "cf"), column(p, "ret")
    assert [cf[t] for t in range(10)] == [10.0] + [11.0] * 6 + [None, 22.0, 22.0]
    assert ret[8] == pytest.approx(math.log(2)) and ret[7] is None and ret[3] == 0


def test_volatility_counts_returns_not_rows(spark):
    points = [(t, 100.0 * (1.01 if t % 2 else 1.0)) for t in range(60) if not 20 <= t < 30]
    p = panel.volatility(panel.log_return(panel.carry_forward(panel.dense(series(spark, points)), roll=0)))
    sigma, ret = column(p, "sigma"), column(p, "ret")
    first = min(t for t, s in sigma.items() if s is not None)
    assert sum(ret[t] is not None for t in range(first + 1)) == 40


def test_upper_median(spark):
    rows = [(day(t), "A", 1.0, 1.0, 1.0, 1.0, float(t + 1)) for t in range(20)]
    p = panel.traded_value(panel.carry_forward(panel.dense(spark.createDataFrame(rows, BARS))))
    value = column(p, "value")
    assert value[19] == 11.0 and value[18] is None


def test_most_traded_ties(spark):
    rows = spark.createDataFrame([(0, "A", 3.0, True), (0, "B", 3.0, True), (0, "C", 5.0, True), (0, "D", 9.0, False)], "t long, ticker string, value double, tradable boolean")
    kept = lambda df: sorted(r.ticker for r in df.where("tradable").collect())
    assert kept(panel.most_traded(rows, 2)) == ["A", "B"]
    assert kept(panel.most_traded(rows, 2, by_ticker=False)) == ["A", "C"]


def test_outliers(spark):
    rows = [(day(0), "A", 100.0, 101.0, 49.9, 101.0, 1.0), (day(1), "A", 100.0, 101.0, 50.1, 101.0, 1.0), (day(2), "A", 100.0, 202.1, 100.0, 101.0, 1.0)]
    assert [r.d for r in clean.drop_outliers(spark.createDataFrame(rows, BARS)).collect()] == [day(1)]


def test_repair_units(spark):
    rows = spark.createDataFrame([(t, day(t), "A", *[c] * 4, 1.0) for t, c in enumerate([100.0, 101.0, 1.02, 1.03, 104.0, 10500.0, 106.0])], "t long, d date, ticker string, o double, h double, l double, c double, v double")
    got = [r.c for r in clean.repair_units(rows).orderBy("t").collect()]
    assert got == pytest.approx([100, 101, 102, 103, 104, 105, 106])


def test_split_ratios(spark):
    text = spark.createDataFrame([("2-1",), ("2:1",), ("2/1",), ("2.5",), ("x",), (None,), ("1/0",)], "x string")
    assert [r[0] for r in text.select(clean.split_ratio(F.col("x"))).collect()] == [2.0, 2.0, 2.0, 2.5, None, None, None]


def test_splice_units_and_guard(spark):
    new = spark.createDataFrame([(day(30 + t), "A", 102.0, 102.0, 102.0, 102.0 + t, 1.0) for t in range(30)], BARS)
    old = spark.createDataFrame([(day(t), "A", 1.0, 1.0, 1.0, 1.02 if t == 30 else 1.0, 1.0) for t in range(31)], BARS)
    out = clean.splice(new, old).orderBy("d").collect()
    assert len(out) == 60 and out[0].c == pytest.approx(100.0)
    far = old.withColumn("c", F.col("c") / 1e6)
    assert clean.splice(new, far).count() == 30


def test_costs(spark):
    m = lambda name, v, s=0.0, free=False: (F.lit(name), F.lit(v), F.lit(s), F.lit(free))
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    uk = m("UK", 5000.0)
    assert get(costs.commission(*uk[:3])) == 3.0 and get(costs.round_trip(*uk)) == pytest.approx(0.0062)
    us = m("US", 5000.0, 100.0)
    assert get(costs.commission(*us[:3])) == 1.0 and get(costs.sale_fee(*us[:3])) == pytest.approx(0.1556)
    assert get(costs.to_tick(F.lit(340.47), F.lit(0.5))) == 340.0


def test_expected_by_rank(spark):
    trades = [(i, 0, 1, 10, 0.02) for i in range(50)] + [(100, 0, 20, 30, 0.0), (101, 1, 20, 30, 0.0), (102, 0, 5, 30, 0.0)]
    df = spark.createDataFrame(trades, "id long, rank long, opened long, closed long, ret double")
    got = {r.id: r.expected for r in evaluate.expected_by_rank(df).collect()}
    assert got[100] == pytest.approx(0.015) and got[101] == pytest.approx(0.01) and got[102] == 0


def test_shrunk_mean(spark):
    one = spark.range(1)
    get = lambda n, s, ss: one.select(evaluate.shrunk_mean(F.lit(float(n)), F.lit(s), F.lit(ss))).first()[0]
    assert get(4, 0.0, 4e-4) == 0 and get(1, 0.1, 0.01) == 0 and get(4, 0.4, 0.04) == pytest.approx(0.1)


def test_choose_k_takes_the_gaining_size(spark):
    rows = [(k, u, (0.001 if k == 5 else -0.001) * (1 + u % 3)) for k in (2, 5) for u in range(100)] + [(2, 500, 0.1)]
    got = evaluate.choose_k(spark.createDataFrame(rows, "k int, u long, ret double")).collect()
    assert len(got) == 100 and all(r.k == 5 for r in got)


def test_as_of(spark):
    left = spark.createDataFrame([(9,), (30,), (31,), (40,)], "t long")
    right = spark.createDataFrame([(10, 1), (31, 2)], "t long, fit int")
    got = {r.t: r.fit for r in indicators.as_of(left, right, [], "t", "fit").collect()}
    assert got == {9: None, 30: 1, 31: 2, 40: 2}


def test_parabolic_sar_turns(spark):
    closes = [10 + t for t in range(15)] + [24 - t for t in range(15)]
    rows = [(day(t), "A", c, c + 0.5, c - 0.5, float(c), 1.0) for t, c in enumerate(map(float, closes))]
    got = indicators.parabolic_sar(spark.createDataFrame(rows, BARS)).orderBy("d").collect()
    assert got[10].rising and not got[-1].rising
    assert all((r.sar < lo if r.rising else r.sar > hi) for r, (_, _, _, hi, lo, _, _) in list(zip(got, rows))[2:12])


def test_strategy_parameters():
    assert set(strategies.REGISTRY) == {"momentum", "trend", "lowvol", "reversal", "resmom", "high52", "lowmax", "ltrev"}
    assert strategies.parameters("ltrev", skip=100)["skip"] == 100
    with pytest.raises(KeyError):
        strategies.parameters("momentum", nothing=1)
    with pytest.raises(KeyError):
        strategies.parameters("none")


@pytest.fixture(scope="module")
def market(spark):
    return source.synthetic(spark, tickers=8, sessions=420).cache()


def _ranks(bars, name):
    rows = panel.with_market(panel.tradable(panel.features(bars)))
    out = strategies.ranked(strategies.scores(rows, name, **({"lookback": 300, "skip": 100} if name == "ltrev" else {})))
    return {(r.d, r.ticker): (round(r.score, 9), r.rank) for r in out.where("t >= 300").collect()}


@pytest.mark.parametrize("name", sorted(strategies.REGISTRY))
def test_no_look_ahead(spark, market, name):
    """Cutting the last sessions off changes nothing before."""
    cut = market.select("d").distinct().orderBy("d").collect()[380].d
    full, part = _ranks(market, name), _ranks(market.where(F.col("d") < F.lit(cut)), name)
    assert part and {k: v for k, v in full.items() if k[0] < cut} == part


def test_partitioning_doesnt_matter(spark, market):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = _ranks(market, "resmom")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert _ranks(market.repartition(7), "resmom") == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_features_need_few_exchanges(spark, market):
    df = panel.features(spark.createDataFrame(market.limit(50).toPandas(), BARS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5 and "Python" not in plan and "CartesianProduct" not in plan


def test_bootstrap_stays_in_the_window(spark):
    out = simulate.bootstrap_days(spark.createDataFrame([(300,), (900,)], "t0 long"), paths=20, horizon=21)
    rows = out.collect()
    assert len(rows) == 2 * 20 * 21 and all(max(1, r.t0 - 749) <= r.q <= r.t0 for r in rows)
    assert sorted(rows) == sorted(out.repartition(5).collect())


def test_csv_source(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ticker,date,close,open,high,low,volume\nA,2020-01-02T00:00,2,2,3,1,x\nA,2020-01-02,2.5,2,3,1,7\nB,2020-01-02,0,1,1,1,1\nC,bad,1,1,1,1,1\n")
    got = source.read_csv(spark, str(tmp_path / "b.csv")).collect()
    assert [(r.ticker, r.c, r.v) for r in got] == [("A", 2.5, 7.0)]


def test_lists_venues_and_stores(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\nAAA x\n\n  BBB\nAAA\n")
    assert sorted(r.ticker for r in source.read_list(spark, str(tmp_path / "l.txt")).collect()) == ["AAA", "BBB"]
    (tmp_path / "v.txt").write_text("# x\nPAR 5000 .0005 3 0 0.003 0 .004\nAMS 5000 .0005 3 0 0.001 0\n")
    assert {r.exchange: r.held_tax for r in source.read_venues(spark, str(tmp_path / "v.txt")).collect()} == {"PAR": 0.004, "AMS": 0.001}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "A.json").write_text('{"2020-01-02":{"c":2.0},"bad":{"c":1},"2020-01-03":{"o":1,"h":2,"l":1,"c":0,"v":1}}')
    got = source.read_store(spark, str(tmp_path / "s")).collect()
    assert [(r.ticker, r.o, r.c, r.v) for r in got] == [("A", 2.0, 2.0, 0.0)]


def test_inferred_split_and_plain_series(spark):
    from barloom.operators import ingest

    rows = [(day(t), "A", *[(100.0 if t < 30 else 50.0) + t % 3] * 4, 1000.0 if t < 30 else 2500.0) for t in range(60)]
    rows += [(day(t), "B", *[(100.0 if t < 30 else 50.0) + t % 3] * 4, 1000.0) for t in range(60)]
    got = {(r.ticker, r.d): r for r in ingest.infer_splits(spark.createDataFrame(rows, BARS)).collect()}
    assert got["A", day(0)].c == pytest.approx(50.0) and got["A", day(0)].v == pytest.approx(2000.0) and got["A", day(59)].v == 2500.0
    assert got["B", day(0)].c == 100.0 and len(got) == 120


def test_outlook_case(spark):
    from barloom.operators import ingest

    orders = spark.createDataFrame([(0.006, 3.0), (0.002, 2.0)], "expected double, hold double")
    trades = spark.createDataFrame([("2026-01-02", 0.01, 0.004, True), ("2026-01-03", 0.01, 0.001, True), ("2026-01-04", 0.01, 0.9, False)], "d string, expected double, ret double, filled boolean")
    r = ingest.outlook(orders, trades, 2).first()
    w = 0.5**0.1
    assert r.expected == pytest.approx(0.0015) and r.delivered == pytest.approx((w * 0.004 + 0.001) / (w * 0.01 + 0.01)) and r.outlook == pytest.approx(r.expected * r.delivered)


def test_scalars(spark):
    from barloom.functions import scalars

    texts = ["", "abc", "é" * 20, "日本語テキスト", "😀😀😀", "a😀b", "abcdefghijkl"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for n in (1, 3, 4, 7, 12):
        want = [t.encode()[:n].decode("utf-8", "ignore") for t in texts]
        assert [r[0] or "" for r in df.select(scalars.first_bytes(F.col("x"), n)).collect()] == want
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalars.exchange_of(F.lit("LON:VOD"))) == "LON" and get(scalars.exchange_of(F.lit("VOD"))) is None and get(scalars.code_of(F.lit("LON:VOD"))) == "VOD"
    assert get(scalars.safe_name(F.lit("a/b:c.d-e é"))) == "a_b_c.d-e__"
    assert [int(x) for x in scalars.mix64([0, 1])] == [0xE220A8397B1DCDAF, 0x910A2DEC89025CC1]


def test_selection_and_updates(spark):
    from barloom.operators import ingest

    book = spark.createDataFrame([("B", 1), ("A", 0)], "ticker string, rank int")
    candidates = spark.createDataFrame([("A", 0), ("C", 1), ("D", 2)], "ticker string, rank int")
    assert [r.ticker for r in ingest.selected(book, candidates, 3).collect()] == ["A", "B", "C"]
    flow = spark.createDataFrame([("A", 90), ("Z", 80), ("Y", 1)], "ticker string, last_held int")
    assert {r.ticker: r.keep for r in ingest.updates(book, flow, 100, 50).collect()} == {"A": True, "B": True, "Z": False}
    bars = spark.createDataFrame([(day(0), "FRA:RHM", 1.0), (day(0), "AMS:RHM", 2.0), (day(0), "AMS:ASM", 3.0)], "d date, ticker string, c double")
    pick = lambda x: [r.c for r in ingest.by_ticker_or_code(bars, x).collect()]
    assert pick("FRA:RHM") == [1.0] and pick("RHM") == [2.0] and pick("LON:ASM") == [3.0] and pick("NO") == []
