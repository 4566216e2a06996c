"""Queries over bars derived from the driver's tables: sources, cleaning, features, universe, strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import clean, panel, strategies
from barloom.plans import sql
from barloom.plans.catalog import ORACLE, QUERIES
from barloom.sources import bars as source

MIN_PRICE, MIN_VALUE = 90.0, 500.0


def register(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def rnd(df: DataFrame, places: int = 8, *keep: str) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show; -0 becomes 0."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries start from, made once a session and then kept (in memory, else on the executors' disks).

    A lost executor's part is made again. ``forget`` gives them back, as after the tables have changed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = made().persist(StorageLevel.MEMORY_AND_DISK)
    return _KEPT[key]


def forget() -> None:
    for df in _KEPT.values():
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()
    _KEPT.clear()


def bars(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    return _kept(spark, sf_dir, f"bars by {key}", lambda: source.bars(spark, sf_dir, key))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "features", lambda: panel.features(bars(spark, sf_dir)))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.tradable(features(spark, sf_dir), MIN_PRICE, MIN_VALUE)


def with_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "market", lambda: panel.with_market(universe(spark, sf_dir)))


def ranking(spark: SparkSession, sf_dir: str, name: str, invert: bool = False) -> DataFrame:
    """Ranks on rebalance days: windows first, then the filter, then ranks over what is left."""
    p = strategies.parameters(name)
    # only the strategies that regress on the market need its return
    rows = with_market(spark, sf_dir) if name in ("reversal", "resmom") else universe(spark, sf_dir)
    scored = strategies.scores(rows, name, invert)
    return strategies.ranked(strategies.rebalance_days(scored, int(p["rebalance"]), int(p["warmup"])))


def r(*cols: str, places: int = 8) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 {c}" for c in cols)


@register("bars_ohlcv", sql.query(sql.bars(), f"select ticker, d, {r('o', 'h', 'l', 'c', 'v', places=6)} from bars"))
def bars_ohlcv(spark, sf_dir):
    return rnd(bars(spark, sf_dir), 6)


@register("bars_valid", sql.query(sql.bars("p_type"), f"select ticker, d, {r('o', 'h', 'l', 'c', 'v', places=6)} from bars where o > 0 and h > 0 and l > 0 and c > 0 and h >= l and c >= o"))
def bars_valid(spark, sf_dir):
    return rnd(source.valid(source.bars(spark, sf_dir, "p_type")).where("c >= o"), 6)


@register("sessions", sql.query(sql.panel(), "select d, t from cal"))
def sessions(spark, sf_dir):
    return panel.sessions(bars(spark, sf_dir))


@register("panel_dense", sql.query(sql.panel(), f"select t, d, ticker, {r('o', 'h', 'l', 'c', 'v', places=6)} from panel"))
def panel_dense(spark, sf_dir):
    return rnd(panel.dense(bars(spark, sf_dir)), 6)


@register("carry_forward", sql.query(sql.carried(), f"select t, ticker, {r('cf', places=6)} from cf"))
def carry_forward(spark, sf_dir):
    return rnd(panel.carry_forward(panel.dense(bars(spark, sf_dir))).select("t", "ticker", "cf"), 6)


@register("log_return", sql.query(sql.returns(), f"select t, ticker, {r('ret')} from ret"))
def log_return(spark, sf_dir):
    return rnd(panel.log_return(panel.carry_forward(panel.dense(bars(spark, sf_dir)))).select("t", "ticker", "ret"))


@register("rolling_vol60", sql.query(sql.features(), f"select t, ticker, {r('sigma')} from feat"))
def rolling_vol60(spark, sf_dir):
    return rnd(features(spark, sf_dir).select("t", "ticker", "sigma"))


@register("median_value20", sql.query(sql.features(), f"select t, ticker, {r('value', places=4)} from feat"))
def median_value20(spark, sf_dir):
    return rnd(features(spark, sf_dir).select("t", "ticker", "value"), 4)


@register("first_bar", sql.query(sql.carried(), "select ticker, min(first_t) first_t from cf group by ticker"))
def first_bar(spark, sf_dir):
    return panel.first_bar(panel.dense(bars(spark, sf_dir))).groupBy("ticker").agg(F.min("first_t").alias("first_t"))


@register("change_12_1", sql.query(sql.carried(), f"select t, ticker, {r('x')} from (select t, ticker, {sql.change(252, 21)} x from cf window w as {sql.BY})"))
def change_12_1(spark, sf_dir):
    return rnd(panel.carry_forward(panel.dense(bars(spark, sf_dir))).select("t", "ticker", panel.change(252, 21).alias("x")))


@register("universe_daily", sql.query(sql.universe(), "select t, ticker, tradable from uni"))
def universe_daily(spark, sf_dir):
    return universe(spark, sf_dir).select("t", "ticker", "tradable")


_TOP = """, r1 as (select *, row_number() over (partition by t, tradable order by value desc nulls last, ticker) k from uni),
r2 as (select *, min(case when k <= 8 then value end) over (partition by t, tradable) cut from r1),
r3 as (select *, sum(cast(value >= cut as int)) over (partition by t, tradable order by ticker rows unbounded preceding) kept from r2)"""


@register("universe_top_n", sql.query(sql.universe() + _TOP, "select t, ticker, tradable and coalesce(value >= cut and kept <= 8, false) tradable from r3"))
def universe_top_n(spark, sf_dir):
    return panel.most_traded(universe(spark, sf_dir), 8).select("t", "ticker", "tradable")


@register("universe_top_n_by_value", sql.query(sql.universe() + _TOP, "select t, ticker, tradable and k <= 8 tradable from r3"))
def universe_top_n_by_value(spark, sf_dir):
    return panel.most_traded(universe(spark, sf_dir), 8, by_ticker=False).select("t", "ticker", "tradable")


@register("market_return", sql.query(sql.universe(), f"select t, d, {r('mkt')} from mkt"))
def market_return(spark, sf_dir):
    return rnd(panel.market_return(universe(spark, sf_dir)))


def _strategy(name: str) -> None:
    @register(f"score_{name}", sql.query(sql.scored(name), f"select t, d, ticker, {r('score', places=6)}, rank from ranked"))
    def score(spark, sf_dir):
        return rnd(ranking(spark, sf_dir, name).select("t", "d", "ticker", "score", "rank"), 6)


for _name in strategies.REGISTRY:
    _strategy(_name)


@register("rank_topk", sql.query(sql.scored("momentum"), "select t, ticker, rank, rank >= 5 reserve from ranked where rank < 10"))
def rank_topk(spark, sf_dir):
    return ranking(spark, sf_dir, "momentum").where("rank < 10").select("t", "ticker", "rank", (F.col("rank") >= 5).alias("reserve"))


@register("rank_inverted", sql.query(sql.scored("momentum", True), f"select t, ticker, {r('score', places=6)}, rank from ranked where rank < 5"))
def rank_inverted(spark, sf_dir):
    return rnd(ranking(spark, sf_dir, "momentum", True).where("rank < 5").select("t", "ticker", "score", "rank"), 6)


_POOL = sql.query(
    sql.universe()
    + f""", sa as (select t, ticker, 'momentum' strategy, {sql.SCORES['momentum'][1]} score from pan window w as {sql.BY}),
sb as (select t, ticker, 'high52' strategy, {sql.SCORES['high52'][1]} score from pan),
tr as (select t, ticker, tradable from pan where t >= 260 and (t - 260) % 21 = 0),
lists as (select t, ticker, strategy, row_number() over (partition by t, strategy order by score desc, ticker) - 1 rank
  from (select * from sa union all select * from sb) join tr using (t, ticker) where tradable and score is not null),
firsts as (select t, ticker, min(struct_pack(rank := rank, strategy := strategy)) f from lists group by t, ticker)""",
    """select t, ticker, f.rank as rank, f.strategy as strategy, place from
  (select *, row_number() over (partition by t order by f, ticker) - 1 place from firsts) where place < 10""",
)


@register("strategy_pool_round_robin", _POOL)
def strategy_pool(spark, sf_dir):
    lists = [ranking(spark, sf_dir, n).select("t", "ticker", "rank", F.lit(n).alias("strategy")) for n in ("momentum", "high52")]
    return strategies.pool(lists[0].unionByName(lists[1]), 10)


_NN = """, nf as (select t, ticker, tradable, ret, {c1} m12, {c2} m1, stddev_pop(ret) {b} vol, cf / max(cf) {b2} - 1 high from pan window w as {by}),
ok as (select * from nf where tradable and t % 21 = 8)
select t, ticker, {ranks} from ok"""
_RANK = "case when {c} is not null and count({c}) over (partition by t) > 1 then (row_number() over (partition by t order by {c} nulls last, ticker) - 1) / (count({c}) over (partition by t) - 1) - 0.5 end"


@register(
    "nn_features_rank",
    sql.query(
        sql.universe(),
        _NN.format(
            c1=sql.change(252, 21), c2=sql.change(21), b=sql.back(63), b2=sql.back(252), by=sql.BY, ranks=", ".join(f"round({_RANK.format(c=c)}, 8) + 0.0 {c}" for c in ("m12", "m1", "vol", "high"))
        ),
    ),
)
def nn_features_rank(spark, sf_dir):
    cols = {"m12": panel.change(252, 21), "m1": panel.change(21), "vol": F.stddev_pop("ret").over(panel.back(63)), "high": F.col("cf") / F.max("cf").over(panel.back(252)) - 1}
    rows = universe(spark, sf_dir).select("t", "ticker", "tradable", *(v.alias(k) for k, v in cols.items())).where("tradable and t % 21 = 8")
    return rnd(rows.select("t", "ticker", *(strategies.cross_rank(c).alias(c) for c in cols)))


@register(
    "market_features",
    sql.query(sql.universe(), f"select t, {r('m12', 'vol')} from (select t, least(1, greatest(-1, sum(mkt) over w)) m12, least(1, greatest(0, stddev_pop(mkt) over v * sqrt(252))) vol from mkt window w as (order by t rows 251 preceding), v as (order by t rows 62 preceding))"),
)
def market_features(spark, sf_dir):
    one = lambda n: Window.orderBy("t").rowsBetween(-(n - 1), 0)
    clamp = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    m = panel.market_return(universe(spark, sf_dir))
    return rnd(m.select("t", clamp(F.sum("mkt").over(one(252)), -1.0, 1.0).alias("m12"), clamp(F.stddev_pop("mkt").over(one(63)) * F.sqrt(F.lit(252.0)), 0.0, 1.0).alias("vol")))


# ------------------------------------------------------------------------------------------ cleaning


def broken_units(spark, sf_dir) -> DataFrame:
    """Bars whose prices are a hundred times too high up to the middle of 1997, for some tickers."""
    k = F.when((F.col("d") < F.lit("1997-07-01").cast("date")) & F.col("ticker").endswith("1"), 100.0).otherwise(1.0)
    return bars(spark, sf_dir).select("ticker", "d", *((F.col(x) * k).alias(x) for x in clean.PRICES), "v")


_BROKEN = sql.bars() + ", bk as (select ticker, d, {p}, v from (select *, case when d < date '1997-07-01' and ticker like '%1' then 100.0 else 1.0 end k from bars))".format(p=", ".join(f"{x} * k {x}" for x in "ohlc"))
_DAYS = "row_number() over (partition by ticker order by d) - 1"


@register(
    "repair_units",
    sql.query(
        _BROKEN
        + f""", st as (select *, c / lead(c) over (partition by ticker order by d) q from bk),
ex as (select *, sum(case when q > 50 and q < 200 then -1 when q > 0.005 and q < 0.02 then 1 else 0 end) over (partition by ticker order by d desc rows unbounded preceding) e from st)
select d, ticker, {', '.join(f'round({x} * power(100.0, e), 6) + 0.0 {x}' for x in 'ohlc')}, v from ex""",
    ),
)
def repair_units(spark, sf_dir):
    rows = broken_units(spark, sf_dir).withColumn("t", F.datediff("d", F.lit("1970-01-01").cast("date")))
    return rnd(clean.repair_units(rows).select("d", "ticker", *clean.PRICES, "v"), 6, "v")


_BAD = sql.bars() + ", bb as (select ticker, d, o, case when day(d) = 7 then h * 2.5 else h end h, case when day(d) = 3 then l * 0.3 else l end l, c, v from bars)"


@register("roll_outliers", sql.query(_BAD, f"select ticker, d, {r('o', 'h', 'l', 'c', 'v', places=6)} from bb where not (l > h or l < 0.5 * least(o, c) or h > 2 * greatest(o, c) or o <= 0 or h <= 0 or l <= 0)"))
def roll_outliers(spark, sf_dir):
    day = F.dayofmonth("d")
    bad = bars(spark, sf_dir).withColumn("h", F.when(day == 7, F.col("h") * 2.5).otherwise(F.col("h"))).withColumn("l", F.when(day == 3, F.col("l") * 0.3).otherwise(F.col("l")))
    return rnd(clean.drop_outliers(bad), 6)


_SPLITS = [("Brand#11", "1997-03-03", "2-1"), ("Brand#11", "1999-05-05", "3:2"), ("Brand#23", "1998-08-08", "1/4"), ("Brand#34", "2000-02-02", "5"), ("Brand#34", "2000-02-03", "bad")]


@register(
    "split_adjust",
    sql.query(
        sql.bars()
        + f""", sp as (select ticker, cast(s.day as date) "day", case when strpos(x, '-') + strpos(x, ':') + strpos(x, '/') > 0
  then try_cast(regexp_extract(x, '^([0-9.]+)[-:/]([0-9.]+)$', 1) as double) / try_cast(regexp_extract(x, '^([0-9.]+)[-:/]([0-9.]+)$', 2) as double) else try_cast(x as double) end ratio
  from (values {', '.join(str(s) for s in _SPLITS)}) s(ticker, "day", x)),
k as (select b.*, coalesce((select exp(sum(ln(ratio))) from sp where sp.ticker = b.ticker and sp.day > b.d and ratio > 0), 1) k from bars b)
select ticker, d, {', '.join(f'round({x} / k, 6) + 0.0 {x}' for x in 'ohlc')}, round(v * k, 6) + 0.0 v from k""",
    ),
)
def split_adjust(spark, sf_dir):
    splits = spark.createDataFrame(_SPLITS, "ticker string, day string, x string").select("ticker", F.to_date("day").alias("day"), clean.split_ratio(F.col("x")).alias("ratio"))
    return rnd(clean.adjust_splits(bars(spark, sf_dir), splits), 6)


@register("inverse_series", sql.query(sql.bars(), "select ticker || '-' ticker, d, round(1 / o, 10) + 0.0 o, round(1 / l, 10) + 0.0 h, round(1 / h, 10) + 0.0 l, round(1 / c, 10) + 0.0 c, v from bars"))
def inverse_series(spark, sf_dir):
    return rnd(clean.inverse(bars(spark, sf_dir)), 10, "v")


@register(
    "override_nearest_scale",
    sql.query(
        sql.bars()
        + f""", ov as (select ticker, d, o * 100 no, h * 100 nh, l * 100 nl, c * 100.5 nc, v + 1 nv from bars where day(d) % 5 = 0 and month(d) <> 6
  union all select ticker, d, o * 7, h * 7, l * 7, c * 7, v from bars where day(d) % 5 = 0 and month(d) = 6),
j as (select b.*, no, nh, nl, nc, nv, case when abs(ln(c / nc / 0.01)) <= 0.2 then 0.01 end s from bars b left join ov using (ticker, d))
select ticker, d, {', '.join(f'round(case when s is not null then n{x} * s else {x} end, 6) + 0.0 {x}' for x in 'ohlc')}, case when s is not null then nv else v end v from j""",
    ),
)
def override_nearest_scale(spark, sf_dir):
    b = bars(spark, sf_dir)
    some = b.where(F.dayofmonth("d") % 5 == 0)
    june = F.month("d") == 6
    other = some.select("ticker", "d", *((F.col(x) * F.when(june, 7.0).otherwise(100.5 if x == "c" else 100.0)).alias(x) for x in clean.PRICES), F.when(june, F.col("v")).otherwise(F.col("v") + 1).alias("v"))
    return rnd(clean.override(b, other), 6, "v")


@register(
    "splice_history",
    sql.query(
        sql.bars()
        + f""", nw as (select * from bars where d >= date '1998-01-01'), od as (select ticker, d, o / 100 o, h / 100 h, l / 100 l, c / 100 c, v from bars where d < date '1998-06-01'),
k as (select ticker, first(c / oc order by d) k from (select n.ticker, n.d, n.c, o.c oc from nw n join od o using (ticker, d)) group by ticker),
bg as (select ticker, min(d) b from nw group by ticker)
select ticker, d, {r('o', 'h', 'l', 'c', 'v', places=6)} from (select ticker, d, o, h, l, c, v from nw union all
  select od.ticker, od.d, o * k, h * k, l * k, c * k, v from od join k using (ticker) join bg using (ticker) where od.d < b and k > 0.004 and k < 250)""",
    ),
)
def splice_history(spark, sf_dir):
    b = bars(spark, sf_dir)
    old = b.where("d < date '1998-06-01'").select("ticker", "d", *((F.col(x) / 100).alias(x) for x in clean.PRICES), "v")
    return rnd(clean.splice(b.where("d >= date '1998-01-01'"), old), 6)


_VENUE = "case when qty % 2 = 0 then 'AMS' else 'PAR' end"


@register(
    "first_exchange_with_bars",
    sql.query(
        sql.trades("p_type") + ", vb as (select ticker code, case when ticker like '%STEEL' then 'FRA' when day(d) % 2 = 0 then 'AMS' else 'PAR' end exchange, d, max(price) h from li group by all)",
        """, best as (select code, first(exchange order by case exchange when 'PAR' then 1 when 'AMS' then 2 else 3 end) exchange from (select distinct code, exchange from vb) group by code)
select code, exchange, d, round(h, 6) + 0.0 h from vb join best using (code, exchange)""",
    ),
)
def first_exchange_with_bars(spark, sf_dir):
    ex = F.when(F.col("ticker").endswith("STEEL"), "FRA").when(F.dayofmonth("d") % 2 == 0, "AMS").otherwise("PAR")
    rows = source.trades(spark, sf_dir, "p_type").select(F.col("ticker").alias("code"), ex.alias("exchange"), "d", "price").groupBy("code", "exchange", "d").agg(F.max("price").alias("h"))
    order = F.when(F.col("exchange") == "PAR", 1).when(F.col("exchange") == "AMS", 2).otherwise(3)
    return rnd(clean.first_with_bars(rows, rows.select("code", "exchange").distinct().withColumn("pref", order)), 6)


@register("merge_bars_replace", sql.query(sql.bars(), "select ticker, d, round(c, 6) + 0.0 c from bars where day(d) % 3 <> 0 union all select ticker, d, round(c * 2, 6) + 0.0 c from bars where day(d) % 3 = 0"))
def merge_bars_replace(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "d", "c")
    return rnd(source.upsert(b, b.where(F.dayofmonth("d") % 3 == 0).withColumn("c", F.col("c") * 2)), 6)


@register(
    "jump_filter",
    sql.query(
        _BROKEN.replace("'%1'", "'%1' and ticker <> 'Brand#11'"),
        """, p as (select *, lag(c) over w p, list(c) over (partition by ticker order by d rows between current row and 5 following) a from bk window w as (partition by ticker order by d))
select distinct ticker from p where abs(ln(c / p)) > ln(1.6) and len(list_filter(a, lambda x: abs(ln(x / p)) < ln(1.25))) = 0""",
    ),
)
def jump_filter(spark, sf_dir):
    k = F.when((F.col("d") < F.lit("1997-07-01").cast("date")) & F.col("ticker").endswith("1") & (F.col("ticker") != "Brand#11"), 100.0).otherwise(1.0)
    return clean.jumpy(bars(spark, sf_dir).withColumn("c", F.col("c") * k))


@register(
    "fetch_plan",
    sql.query(
        sql.bars("cast(l_suppkey as varchar)"),
        "select ticker, max(d) last, case when max(d) >= date '2001-10-20' then 'current' when max(d) = date '2001-10-19' then 'quote' else 'gap' end plan from bars group by ticker",
    ),
)
def fetch_plan(spark, sf_dir):
    li = source.table(spark, sf_dir, "lineitem").join(source.table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    stored = li.select(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("d"))
    return clean.fetch_plan(stored, F.lit("2001-10-20").cast("date"), F.lit("2001-10-19").cast("date"))


@register("day_list_valid", sql.query(sql.bars(), "select list_day, true same, count(*) n from (select date_trunc('month', d)::date + 14 list_day, d from bars where day(d) = 15 or (day(d) = 16 and month(d) = 3)) group by list_day having bool_and(d = list_day) and count(*) >= 10"))
def day_list_valid(spark, sf_dir):
    day = F.dayofmonth("d")
    rows = bars(spark, sf_dir).where((day == 15) | ((day == 16) & (F.month("d") == 3))).select(F.date_add(F.trunc("d", "month"), 14).alias("list_day"), "d")
    return clean.valid_day_list(rows, 10)
