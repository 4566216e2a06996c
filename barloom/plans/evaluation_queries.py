"""Queries over rankings, orders, backtests and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import costs, evaluate, indicators, panel, simulate
from barloom.plans import sql
from barloom.plans.panel_queries import bars, features, r, ranking, register, rnd, universe
from barloom.sources import bars as source

K = 5


@register("buy_cap_limit", sql.query(sql.scored("momentum"), ", x as (select t, ticker, rank, cf * (1 + least(0.03, 1.5 * coalesce(sigma, 0.02))) lim from ranked join pan using (t, ticker) where rank < 5) select t, ticker, rank, round(lim, 6) + 0.0 lim from x"))
def buy_cap_limit(spark, sf_dir):
    top = ranking(spark, sf_dir, "momentum").where("rank < 5")
    return rnd(top.select("t", "ticker", "rank", (F.col("cf") * (1 + costs.cap(F.col("sigma")))).alias("lim")), 6)


@register(
    "fill_rate_year",
    sql.query(
        sql.features(),
        f""", x as (select t, ticker, case when lead(o) over w is not null and cf is not null then cast(lead(o) over w <= cf * (1 + least(0.03, 1.5 * coalesce(sigma, 0.02))) as double) end hit from feat window w as {sql.BY})
select t, ticker, round(rate, 8) + 0.0 rate from (select t, ticker, avg(hit) over (partition by ticker order by t rows between 251 preceding and 1 preceding) rate from x) where t % 21 = 8""",
    ),
)
def fill_rate_year(spark, sf_dir):
    p = features(spark, sf_dir)
    nxt = F.lead("o").over(panel.by())
    hit = F.when(nxt.isNotNull() & F.col("cf").isNotNull(), (nxt <= F.col("cf") * (1 + costs.cap(F.col("sigma")))).cast("double"))
    rate = F.avg("hit").over(panel.by().rowsBetween(-251, -1))
    return rnd(p.withColumn("hit", hit).select("t", "ticker", rate.alias("rate")).where("t % 21 = 8"))


_ORDERS = """ords as (select o_orderkey, n.n_name name, o_totalprice val, floor(o_totalprice / 50) sh, case n_regionkey when 0 then 'UK' when 1 then 'US' when 2 then 'EU' when 3 then 'FOREX' else 'APAC' end m, o_custkey % 7 = 0 free
  from orders join customer on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey),
com as (select *, case when m = 'FOREX' then greatest(2.0, 2e-5 * val) when m = 'US' then least(0.01 * val, greatest(1.0, 0.005 * sh)) when m = 'UK' then greatest(3.0, 0.0005 * val) else greatest(3.0, 0.0005 * val) end com,
  case when m = 'US' then 2.78e-5 * val + least(8.30, 1.66e-4 * sh) else 0 end fee, cast(case when m in ('US', 'FOREX') then 0 when m = 'UK' and not free then 0.005 else 0 end as double) tax from ords)"""


def _orders(spark, sf_dir) -> DataFrame:
    t = lambda n, *c: source.table(spark, sf_dir, n).select(*c)
    joined = t("orders", "o_orderkey", "o_custkey", "o_totalprice").join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    nation = t("nation", "n_nationkey", "n_regionkey")
    market = F.element_at(F.array(*map(F.lit, ("UK", "US", "EU", "FOREX", "APAC"))), F.col("n_regionkey") + 1)
    joined = joined.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", market.alias("m"), F.col("o_totalprice").alias("val"), F.floor(F.col("o_totalprice") / 50).cast("double").alias("sh"), (F.col("o_custkey") % 7 == 0).alias("free"))


@register(
    "commission_tiered",
    sql.query(
        _ORDERS,
        """select o_orderkey, m market, round(case when m = 'FOREX' then greatest(2.0, 2e-5 * val) when m = 'US' then greatest(0.35, 0.0035 * sh) + 0.0005 * sh
  when m = 'UK' then greatest(1.0, 0.0005 * val) + greatest(0.10, 0.000045 * val) + 0.06 else greatest(3.0, 0.0005 * val) end, 8) + 0.0 com from ords""",
    ),
)
def commission_tiered(spark, sf_dir):
    own = costs.commission(F.col("m"), F.col("val"), F.col("sh"), tiered=True)
    return rnd(_orders(spark, sf_dir).select("o_orderkey", F.col("m").alias("market"), own.alias("com")), 8)


@register("venue_scaling", "select s_name exchange, round(s_acctbal * 2500 / 10000, 6) + 0.0 amount, 0.0005 rate from supplier")
def venue_scaling(spark, sf_dir):
    venues = source.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("exchange"), F.col("s_acctbal").alias("amount"), F.lit(0.0005).alias("rate"))
    return costs.scaled_venues(venues, 2500.0, 10_000.0).withColumn("amount", F.round("amount", 6) + F.lit(0.0))


@register("commission_roundtrip", sql.query(_ORDERS, "select o_orderkey, m market, round(com, 6) + 0.0 com, round(fee, 6) + 0.0 fee, round(tax, 6) + 0.0 tax, round((2 * com + fee) / val + tax, 8) + 0.0 total from com"))
def commission_roundtrip(spark, sf_dir):
    m, v, s, f = F.col("m"), F.col("val"), F.col("sh"), F.col("free")
    rd = lambda c, n: F.round(c, n) + F.lit(0.0)
    return _orders(spark, sf_dir).select(
        "o_orderkey", m.alias("market"), rd(costs.commission(m, v, s), 6).alias("com"), rd(costs.sale_fee(m, v, s), 6).alias("fee"), rd(costs.buy_tax(m, f), 6).alias("tax"), rd(costs.round_trip(m, v, s, f), 8).alias("total")
    )


@register(
    "order_list_net",
    sql.query(
        sql.scored("momentum"),
        """, x as (select t, ticker, rank, rank >= 5 reserve, score / 12 gross, least(5000, 0.5 * value) amount from ranked join pan using (t, ticker) where rank < 10),
y as (select *, 2 * greatest(3.0, 0.0005 * amount) / amount cost from x where amount >= 500)
select t, ticker, rank, reserve, round(gross, 8) + 0.0 gross, round(cost, 8) + 0.0 cost, row_number() over (partition by t order by reserve, round(gross, 8) desc, rank) - 1 as place from y where gross - cost > 0""",
    ),
)
def order_list_net(spark, sf_dir):
    top = ranking(spark, sf_dir, "momentum").where("rank < 10")
    money = costs.amount(5000, F.col("value"), 0.5)
    rows = top.select("t", "ticker", "rank", (F.col("rank") >= 5).alias("reserve"), (F.col("score") / 12).alias("gross"), money.alias("amount")).where("amount >= 500")
    cost = 2 * costs.commission(F.lit("EU"), F.col("amount"), F.lit(0.0)) / F.col("amount")
    rows = rows.withColumn("cost", cost).where("gross - cost > 0").withColumn("gross", F.round("gross", 8))
    place = F.row_number().over(Window.partitionBy("t").orderBy("reserve", F.desc("gross"), "rank")).cast("long") - 1
    return rnd(rows.select("t", "ticker", "rank", "reserve", "gross", "cost", place.alias("place")))


@register(
    "target_turnover",
    sql.query(sql.scored("momentum"), ", tg as (select t, ticker from ranked where rank < 5) select a.t, count(*) n, count(*) filter (where b.ticker is null) fresh from tg a left join tg b on b.t = a.t - 21 and b.ticker = a.ticker group by a.t"),
)
def target_turnover(spark, sf_dir):
    t = ranking(spark, sf_dir, "momentum").where("rank < 5").select("t", "ticker")
    held = Window.partitionBy("ticker").orderBy("t")
    fresh = ~F.coalesce(F.lag("t").over(held) == F.col("t") - 21, F.lit(False))
    return t.withColumn("fresh", fresh).groupBy("t").agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"))


_BT = sql.scored("momentum") + f""", tg as (select ticker, (t - 260) // 21 seg, true want from ranked where rank < {K}),
dy as (select t, ticker, o, cf, (t - 1 - 260) // 21 seg, lag(cf) over w * (1 + least(0.03, 1.5 * coalesce(lag(sigma) over w, 0.02))) lim,
  last_value(cf ignore nulls) over (partition by ticker order by t rows between unbounded preceding and 1 preceding) prev from pan window w as {sql.BY}),
ev as (select dy.*, want, case when want and o > 0 and o <= lim then 1 when want is null and o > 0 then 0 end event from dy left join tg using (ticker, seg) where t > 260),
st as (select *, coalesce(last_value(event ignore nulls) over (partition by ticker order by t rows between unbounded preceding and 1 preceding), 0) was from ev),
ch as (select t u, ticker, was, coalesce(event, was) now, case when was = 1 and coalesce(event, was) = 1 then coalesce(cf, prev) / prev - 1 when was = 1 then o / prev - 1 when coalesce(event, was) = 1 then cf / o - 1 end change, o from st),
dl as (select u, coalesce(sum(change), 0) / {K} ret from ch group by u)"""


def backtest(spark, sf_dir) -> DataFrame:
    """Stop-free momentum book: positions' daily changes."""
    p = universe(spark, sf_dir)
    target = ranking(spark, sf_dir, "momentum").where(F.col("rank") < K)
    return evaluate.held_days(p, target, K, 21, 260)


@register("backtest_positions", sql.query(_BT, f"select u, ticker, {r('change')}, now = 1 held from ch where was = 1 or now = 1"))
def backtest_positions(spark, sf_dir):
    b = backtest(spark, sf_dir).where("change is not null or exit is not null")
    return rnd(b.select("u", "ticker", "change", F.col("exit").isNull().alias("held")))


@register("backtest_daily", sql.query(_BT, f"select u, {r('ret')} from dl"))
def backtest_daily(spark, sf_dir):
    return rnd(evaluate.daily_returns(backtest(spark, sf_dir), K))


_WEALTH = ", wl as (select u, ret, sum(ln(1 + ret)) over (order by u rows unbounded preceding) w from dl), dd as (select *, 1 - exp(w - greatest(max(w) over (order by u rows unbounded preceding), 0)) dd from wl)"


@register("backtest_metrics", sql.query(_BT + _WEALTH, "select round(exp(sum(ln(1 + ret)) * 252 / count(*)) - 1, 8) annual, round(avg(ret) / stddev_pop(ret) * sqrt(252), 8) sharpe, round(max(dd), 8) drawdown, count(*) \"days\" from dd"))
def backtest_metrics(spark, sf_dir):
    return rnd(evaluate.record(evaluate.daily_returns(backtest(spark, sf_dir), K)))


@register("drawdown_curve", sql.query(_BT + _WEALTH, f"select u, {r('w', 'dd')} from dd"))
def drawdown_curve(spark, sf_dir):
    d = evaluate.daily_returns(backtest(spark, sf_dir), K)
    o = Window.orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    w = d.withColumn("w", F.sum(F.log1p("ret")).over(o))
    return rnd(w.select("u", "w", (1 - F.exp(F.col("w") - F.greatest(F.max("w").over(o), F.lit(0.0)))).alias("dd")))


@register(
    "equity_chart_points",
    sql.query(_BT + _WEALTH, ", g as (select u, w, row_number() over (order by u) - 1 i, count(*) over () n, min(w) over () lo, max(w) over () hi, max(u) over () e from wl) select u, round((w - lo) / (hi - lo), 8) + 0.0 x from g where i % greatest(1, cast(ceil(n / 800) as int)) = 0 or u = e"),
)
def equity_chart_points(spark, sf_dir):
    d = evaluate.daily_returns(backtest(spark, sf_dir), K)
    w = d.select("u", F.sum(F.log1p("ret")).over(Window.orderBy("u").rowsBetween(Window.unboundedPreceding, 0)).alias("w"))
    return rnd(indicators.chart_points(w))


_TICKS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 20.0, 50.0, 100.0)


@register("equity_chart_ticks", sql.query(_BT + _WEALTH, f", e as (select min(w) lo, max(w) hi from wl) select m, round((ln(m) - lo) / (hi - lo), 8) + 0.0 y from (values {', '.join(f'({m}::double)' for m in _TICKS)}) x(m), e where ln(m) between lo and hi"))
def equity_chart_ticks(spark, sf_dir):
    d = evaluate.daily_returns(backtest(spark, sf_dir), K)
    w = d.select("u", F.sum(F.log1p("ret")).over(Window.orderBy("u").rowsBetween(Window.unboundedPreceding, 0)).alias("w"))
    return rnd(indicators.chart_ticks(w, _TICKS))


@register("chart_year_starts", sql.query(sql.panel(), 'select distinct on (year(d)) cast(year(d) as int) "label", round(t / (select max(t) from cal), 8) + 0.0 x from cal order by year(d), d'))
def chart_year_starts(spark, sf_dir):
    return rnd(indicators.year_starts(panel.sessions(bars(spark, sf_dir))))


_TRADES = """, tr0 as (select *, sum(case when was = 0 and now = 1 then 1 else 0 end) over (partition by ticker order by u rows unbounded preceding) n from ch where was = 1 or now = 1),
trd as (select ticker, min(u) opened, max(case when now = 0 then u end) closed, exp(sum(ln(1 + change))) - 1 ret from tr0 group by ticker, n)"""


def closed_trades(spark, sf_dir) -> DataFrame:
    """(ticker, opened, closed, ret): positions from their fill to their sale; closed is null while open."""
    b = backtest(spark, sf_dir).where("change is not null or exit is not null")
    n = F.sum(F.col("entry").isNotNull().cast("int")).over(Window.partitionBy("ticker").orderBy("u"))
    return b.withColumn("n", n).groupBy("ticker", "n").agg(F.min("u").alias("opened"), F.max(F.when(F.col("exit").isNotNull(), F.col("u"))).alias("closed"), F.expm1(F.sum(F.log1p("change"))).alias("ret")).drop("n")


@register("trades", sql.query(_BT + _TRADES, f"select ticker, opened, closed, {r('ret')} from trd"))
def trades(spark, sf_dir):
    return rnd(closed_trades(spark, sf_dir))


@register("trade_stats", sql.query(_BT + _TRADES, "select count(*) n, round(avg(ret), 8) mean_trade, round(avg(case when ret > 0 then 1.0 else 0.0 end), 8) win_rate, round(avg(closed - opened), 8) hold_days from trd where closed is not null"))
def trade_stats(spark, sf_dir):
    t = closed_trades(spark, sf_dir).where("closed is not null")
    return rnd(t.agg(F.count("*").alias("n"), F.avg("ret").alias("mean_trade"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(F.col("closed") - F.col("opened")).alias("hold_days")))


_RANKED_TRADES = _BT + _TRADES + """, rt as (select row_number() over (order by opened, ticker) id, ticker, hash_rank rank, opened, closed, ret from (select *, (opened + length(ticker) + cast(right(ticker, 1) as int)) % 5 hash_rank from trd where closed is not null))"""


@register(
    "rank_shrunk_expected",
    sql.query(
        _RANKED_TRADES,
        """, ex as (select a.id, a.rank, coalesce(sum(b.ret), 0) s, count(b.ret) n, coalesce(sum(b.ret) filter (where b.rank = a.rank), 0) rs, count(b.ret) filter (where b.rank = a.rank) rn
  from rt a left join rt b on b.closed <= a.opened group by a.id, a.rank)
select id, rank, round((rs + 50 * (s / (n + 50))) / (rn + 50), 8) + 0.0 expected from ex""",
    ),
)
def rank_shrunk_expected(spark, sf_dir):
    t = closed_trades(spark, sf_dir).where("closed is not null")
    own = t.select(
        F.row_number().over(Window.orderBy("opened", "ticker")).cast("long").alias("id"), ((F.col("opened") + F.length("ticker") + F.substring("ticker", -1, 1).cast("int")) % 5).alias("rank"), "opened", "closed", "ret"
    )
    return rnd(evaluate.expected_by_rank(own).select("id", "rank", "expected"))


# ------------------------------------------------------------------------------------------ the scan over book sizes

def daily_by_k(spark, sf_dir) -> DataFrame:
    """A daily return for each book size: the mean of the first so many series."""
    p = panel.log_return(panel.carry_forward(panel.dense(bars(spark, sf_dir, "p_type")))).where("ret is not null")
    rows = p.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))).where((F.length("ticker") % 6 < F.col("k")) & (F.col("t") >= 1) & ((F.col("t") + F.col("k")) % 97 != 0))
    return rows.groupBy("k", F.col("t").alias("u")).agg(F.round(F.avg("ret"), 12).alias("ret"))


_DK = sql.returns("p_type") + ", dk as (select k, t u, round(avg(ret), 12) ret from ret cross join (values (2), (3), (5)) ks(k) where ret is not null and length(ticker) % 6 < k and t >= 1 and (t + k) % 97 <> 0 group by k, t)"
_SHRUNK = "case when n < 2 then 0 when v <= 1e-18 then m else m * greatest(0, 1 - v / (m * m * n)) end"


@register(
    "choose_k_walkforward",
    sql.query(
        _DK
        + f""", cm as (select dk.* from dk join (select u from dk group by u having count(distinct k) = (select count(distinct k) from dk)) using (u)),
w1 as (select *, count(ret) over w n, coalesce(sum(ret) over w, 0) s, coalesce(sum(ret * ret) over w, 0) ss from cm window w as (partition by k order by u rows between 250 preceding and 1 preceding)),
w2 as (select *, case when n > 0 then s / n else 0 end m, case when n > 0 then greatest(ss / n - (s / n) * (s / n), 0) else 0 end v from w1),
w3 as (select *, case when n >= 60 and m <> 0 then round({_SHRUNK}, 12) else 0 end val from w2)""",
        "select u, last(k order by val, k) k, round(last(ret order by val, k), 8) + 0.0 ret from w3 group by u",
    ),
)
def choose_k_walkforward(spark, sf_dir):
    return rnd(evaluate.choose_k(daily_by_k(spark, sf_dir)))


@register(
    "shrunk_mean_halflife",
    sql.query(
        _DK
        + """, w as (select k, ret, power(0.5, (dense_rank() over (partition by k order by u desc) - 1) / 10.0) w from dk),
g as (select k, sum(w * ret) / sum(w) m, sum(w) * sum(w) / sum(w * w) n, greatest(sum(w * ret * ret) / sum(w) - power(sum(w * ret) / sum(w), 2), 0) v from w group by k)""",
        "select k, round(m, 8) mean, round(n, 6) neff, round(m * greatest(0, 1 - v / (m * m * n)), 8) + 0.0 shrunk from g",
    ),
)
def shrunk_mean_halflife(spark, sf_dir):
    age = F.dense_rank().over(Window.partitionBy("k").orderBy(F.desc("u"))) - 1
    w = daily_by_k(spark, sf_dir).withColumn("w", F.pow(F.lit(0.5), age / 10.0))
    sw, s, ss = F.sum("w"), F.sum(F.col("w") * F.col("ret")), F.sum(F.col("w") * F.col("ret") * F.col("ret"))
    g = w.groupBy("k").agg((s / sw).alias("mean"), (sw * sw / F.sum(F.col("w") * F.col("w"))).alias("neff"), F.greatest(ss / sw - F.pow(s / sw, 2), F.lit(0.0)).alias("v"))
    shrunk = F.col("mean") * F.greatest(F.lit(0.0), 1 - F.col("v") / (F.col("mean") * F.col("mean") * F.col("neff")))
    return g.select("k", (F.round("mean", 8)).alias("mean"), F.round("neff", 6).alias("neff"), (F.round(shrunk, 8) + F.lit(0.0)).alias("shrunk"))


@register(
    "series_intersection",
    sql.query(_DK, "select u, count(*) n, round(sum(ret), 8) + 0.0 total from dk group by u having count(distinct k) = 3"),
)
def series_intersection(spark, sf_dir):
    return rnd(daily_by_k(spark, sf_dir).groupBy("u").agg(F.count("*").alias("n"), F.sum("ret").alias("total")).where("n = 3"))


@register(
    "annual_stats",
    sql.query(_DK, "select k, round(252 * avg(ret), 8) annual, round(avg(ret) / stddev_pop(ret) * sqrt(252), 8) sharpe, count(*) n from dk group by k"),
)
def annual_stats(spark, sf_dir):
    return rnd(daily_by_k(spark, sf_dir).groupBy("k").agg((252 * F.avg("ret")).alias("annual"), (F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"), F.count("*").alias("n")))


@register(
    "market_covariance",
    sql.query(
        _DK
        + """, al as (select u, k, coalesce(ret, 0) ret from (select distinct u from dk) cross join (values (2), (3), (5)) ks(k) left join dk using (u, k)),
w as (select *, power(0.5, (dense_rank() over (order by u desc) - 1) / 10.0) w from al), mn as (select k, sum(w * ret) / sum(w) m from w group by k)""",
        "select a.k k1, b.k k2, round(sum(a.w * (a.ret - ma.m) * (b.ret - mb.m)) / sum(a.w), 12) + 0.0 cov from w a join w b using (u) join mn ma on ma.k = a.k join mn mb on mb.k = b.k group by a.k, b.k",
    ),
)
def market_covariance(spark, sf_dir):
    """Exponentially weighted covariance of the series, a missing day counting as 0. One row a day after the pivot, no self join."""
    ks = (2, 3, 5)
    wide = daily_by_k(spark, sf_dir).groupBy("u").pivot("k", list(ks)).agg(F.first("ret")).na.fill(0.0)
    w = wide.withColumn("w", F.pow(F.lit(0.5), (F.dense_rank().over(Window.orderBy(F.desc("u"))) - 1) / 10.0))
    means = w.agg(*((F.sum(F.col("w") * F.col(f"`{k}`")) / F.sum("w")).alias(f"m{k}") for k in ks))
    both = w.crossJoin(F.broadcast(means))
    cov = [F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2"), (F.sum(F.col("w") * (F.col(f"`{a}`") - F.col(f"m{a}")) * (F.col(f"`{b}`") - F.col(f"m{b}"))) / F.sum("w")).alias("cov")) for a in ks for b in ks]
    return rnd(both.agg(F.array(*cov).alias("x")).select(F.inline("x")), 12)


# ------------------------------------------------------------------------------------------ simulation

_DRAW = "select t0, path, b, ((((m * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) h from (select t0, path, b, ((((((1 * 7919) % 2147483648) + t0 * 112648) % 2147483648 + path * 217377) % 2147483648) + b * 322106) % 2147483648 m from g)"


def _boot(paths: int, resets: str) -> str:
    return f"""{sql.scored('momentum')}, rs as ({resets}), g as (select t0, path, b from rs cross join range({paths}) p(path) cross join range(5) q(b)), hh as ({_DRAW}),
sg as (select *, greatest(1, t0 - 749) lo from hh), sb as (select *, lo + (h // 65536) % (t0 + 1 - lo - 4) s from sg),
dr as (select t0, path, b * 5 + i j, least(t0, s + i) q from sb cross join range(5) z(i) where b * 5 + i < 21)"""


_RESETS = "select distinct t t0 from ranked"
PATHS = 500


def _resets(spark, sf_dir) -> DataFrame:
    return ranking(spark, sf_dir, "momentum").select(F.col("t").alias("t0")).distinct()


@register("bootstrap_days", sql.query(_boot(PATHS, _RESETS), "select t0, path, j, q from dr"))
def bootstrap_days(spark, sf_dir):
    """Drawn sessions of every reset of the ranking, PATHS paths each."""
    return simulate.bootstrap_days(_resets(spark, sf_dir), PATHS)


_MC = _boot(PATHS, _RESETS) + f""", mt as (select t t0, ticker from ranked where rank < {K}),
pr as (select dr.t0, path, mt.ticker, exp(coalesce(sum(ret), 0)) - 1 ret from dr join mt using (t0) left join (select t q, ticker, ret from pan) m on m.q = dr.q and m.ticker = mt.ticker group by dr.t0, path, mt.ticker),
bk as (select t0, path, sum(ret) / {K} ret from pr group by t0, path)"""


def _book(spark, sf_dir) -> DataFrame:
    target = ranking(spark, sf_dir, "momentum").where(F.col("rank") < K).select(F.col("t").alias("t0"), "ticker")
    drawn = simulate.bootstrap_days(target.select("t0").distinct(), PATHS)
    return simulate.book_returns(simulate.path_returns(drawn, panel.log_return(panel.carry_forward(panel.dense(bars(spark, sf_dir)))), target), K)


@register("mc_quantiles", sql.query(_MC, "select t0, round(avg(ret), 8) + 0.0 mean, round(avg(case when ret < 0 then 1.0 else 0 end), 8) p_loss, round(quantile_cont(ret, 0.05), 8) + 0.0 p5, round(quantile_cont(ret, 0.5), 8) + 0.0 p50, round(quantile_cont(ret, 0.95), 8) + 0.0 p95 from bk group by t0"))
def mc_quantiles(spark, sf_dir):
    return rnd(simulate.quantiles(_book(spark, sf_dir), "t0"))


@register(
    "mc_calibration",
    sql.query(
        _MC
        + """, rl as (select x.t t0, sum(x.x) / 5 rr from (select t, ticker, case when lead(cf, 21) over w > 0 and cf > 0 then lead(cf, 21) over w / cf - 1 else 0 end x from pan window w as (partition by ticker order by t)) x join mt on mt.t0 = x.t and mt.ticker = x.ticker group by x.t),
ag as (select t0, any_value(rr) rr, avg(ret) mean, quantile_cont(ret, 0.05) p5, quantile_cont(ret, 0.95) p95, avg(case when ret < rr then 1.0 when ret = rr then 0.5 else 0 end) pit from bk join rl using (t0) group by t0)""",
        'select count(*) resets, round(avg(case when rr between p5 and p95 then 1.0 else 0 end), 8) coverage, round(avg(pit), 8) pit, round(avg(mean), 8) + 0.0 simulated, round(avg(rr), 8) + 0.0 "real", round(corr(mean, rr), 6) + 0.0 correlation from ag',
    ),
)
def mc_calibration(spark, sf_dir):
    p = universe(spark, sf_dir)
    nxt = F.lead("cf", 21).over(panel.by())
    moves = p.select("t", "ticker", F.when((nxt > 0) & (F.col("cf") > 0), nxt / F.col("cf") - 1).otherwise(0.0).alias("x"))
    target = ranking(spark, sf_dir, "momentum").where(F.col("rank") < K).select("t", "ticker")
    real = moves.join(target, ["t", "ticker"]).groupBy(F.col("t").alias("t0")).agg((F.sum("x") / K).alias("real"))
    out = simulate.calibration(_book(spark, sf_dir), real)
    return rnd(out.withColumn("correlation", F.round("correlation", 6)))


# ------------------------------------------------------------------------------------------ indicators


@register("bollinger", sql.query(sql.bars(), f", b as (select ticker, d, c, count(c) over w n, avg(c) over w m, stddev_pop(c) over w s from bars window w as (partition by ticker order by d rows 19 preceding)) select ticker, d, {r('c', places=6)}, round(case when n = 20 then m end, 6) + 0.0 mid, round(case when n = 20 then m + 2 * s end, 6) + 0.0 \"upper\", round(case when n = 20 then m - 2 * s end, 6) + 0.0 \"lower\" from b"))
def bollinger(spark, sf_dir):
    return rnd(indicators.bollinger(bars(spark, sf_dir)), 6)


_SAR = """, b as (select ticker, d, h, l, row_number() over w i, lag(l) over w l1, lag(h) over w h1, coalesce(lag(l, 2) over w, lag(l) over w) l2, coalesce(lag(h, 2) over w, lag(h) over w) h2 from bars window w as (partition by ticker order by d)),
z as (select ticker, d, i, true rising, l sar, h ep, 0.02::double af from b where i = 1
  union all select ticker, d, i, case when turn then not up else up end, case when turn then ep else lim end, case when turn then case when up then l else h end when up then greatest(ep, h) else least(ep, l) end,
    case when turn then 0.02 when up and h > ep or not up and l < ep then least(0.2, af + 0.02) else af end
  from (select b.*, z.rising up, z.ep, z.af, lim, case when z.rising then b.l <= lim else b.h >= lim end turn from z join b on b.ticker = z.ticker and b.i = z.i + 1,
    lateral (select case when z.rising then least(z.sar + z.af * (z.ep - z.sar), b.l1, b.l2) else greatest(z.sar + z.af * (z.ep - z.sar), b.h1, b.h2) end lim)))"""


@register("parabolic_sar", sql.query("recursive " + sql.bars(), _SAR + " select ticker, d, round(sar, 6) + 0.0 sar, rising from z"))
def parabolic_sar(spark, sf_dir):
    return rnd(indicators.parabolic_sar(bars(spark, sf_dir)), 6)


@register(
    "flat_islands",
    sql.query(
        sql.carried("p_brand"),
        """, f as (select ticker "key", t "at", cf is null x, case when t = 0 or (cf is null) <> lag(cf is null) over (partition by ticker order by t) then 1 else 0 end z from cf),
g as (select *, sum(z) over (partition by "key" order by "at" rows unbounded preceding) i from f)
select "key", min("at") "begin", max("at") "end", count(*) n from g group by "key", i having count(*) >= 15""",
    ),
)
def flat_islands(spark, sf_dir):
    p = panel.carry_forward(panel.dense(bars(spark, sf_dir)))
    return indicators.flat_stretches(p.select(F.col("ticker").alias("key"), F.col("t").alias("at"), F.col("cf").isNull().alias("x")))


@register(
    "regime_asof",
    sql.query(
        sql.panel(), """, fits as (select t t0, t * 3 fit from cal where t % 21 = 8), x as (select cal.t, max(t0) t0 from cal left join fits on t0 <= t group by cal.t) select t, t0 * 3 fit from x"""
    ),
)
def regime_asof(spark, sf_dir):
    cal = panel.sessions(bars(spark, sf_dir)).select("t")
    fits = cal.where("t % 21 = 8").select("t", (F.col("t") * 3).alias("fit"))
    return indicators.as_of(cal, fits, [], "t", "fit")
