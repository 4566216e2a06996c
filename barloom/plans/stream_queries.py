"""Queries over the event stream, logs, reports and stateful runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import backtest, models, montecarlo, neural, panel, reports
from barloom.plans import sql
from barloom.plans.catalog import ORACLE
from barloom.plans.evaluation_queries import daily_by_k, order_list_net
from barloom.plans.panel_queries import bars, ranking, register, rnd, universe, with_market
from barloom.sources import bars as source
from barloom.streaming import events

_OHLC = """select cast(date_trunc('hour', ts) as timestamp) "start", event_type, first(value order by ts, event_id) o, max(value) h, min(value) l, last(value order by ts, event_id) c, count(*) n from events group by all"""


def _stream(spark, sf_dir):
    """The events in one batch: files of a table come in no order of time, which later batches would need."""
    return events.read(spark, f"{sf_dir}/events.parquet", files=2**31 - 1)


@register("stream_tumbling_ohlc", _OHLC)
def stream_tumbling_ohlc(spark, sf_dir):
    return events.drained(events.ohlc(_stream(spark, sf_dir)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("events_ohlc", _OHLC)
def events_ohlc(spark, sf_dir):
    rows = source.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.ohlc(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_last_samples", """select cast(time_bucket(interval 30 seconds, ts) as timestamp) "at", event_type, last(value order by ts, event_id) "last" from events group by all""")
def stream_last_samples(spark, sf_dir):
    return events.drained(events.last_samples(_stream(spark, sf_dir)), "complete").withColumn("at", F.col("at").cast("timestamp_ntz"))


def _stateful(spark, make):
    """Runs a stream with state in the store that its operators need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return events.drained(make())
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@register("stream_dedupe", "select user_id, count(distinct event_id) n from events group by user_id")
def stream_dedupe(spark, sf_dir):
    def once():
        rows = _stream(spark, sf_dir)
        return events.deduplicated(rows.union(rows).select("event_id", "user_id", "ts"))

    return _stateful(spark, once).groupBy("user_id").agg(F.count("*").alias("n"))


_BY_USER = "with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) i from events)"


@register(
    "stream_trailing_stops",
    f"""{_BY_USER}, z as (select user_id, i, event_id, value v, value high, null::double was from e where i = 1
  union all select e.user_id, e.i, e.event_id, e.value, case when z.high is not null and e.value <= z.high * 0.5 then null else greatest(coalesce(z.high, e.value), e.value) end, case when z.high is not null and e.value <= z.high * 0.5 then z.high end from z join e on e.user_id = z.user_id and e.i = z.i + 1)
select user_id, event_id, was high, v price from z where was is not null""",
)
def stream_trailing_stops(spark, sf_dir):
    return _stateful(spark, lambda: events.trailing_stops(_stream(spark, sf_dir)))


_GUARD_SQL = f"""{_BY_USER}, g as (select e.*, mode from e cross join (values ('fixed'), ('trail'), ('breakeven')) m(mode)),
z as (select user_id, mode, i, event_id, value v, case when event_type = 'purchase' then 1 else 0 end n, value entry, value high, null::varchar why, null::double paid from g where i = 1
  union all select user_id, mode, i, event_id, v, case when buy then n + 1 when why is not null then 0 else n end, case when buy then (entry * n + v) / (n + 1) else entry end, case when buy and n = 0 then v else greatest(high, v) end, why, case when why is not null then entry end
  from (select g.user_id, g.mode, g.i, g.event_id, g.value v, g.event_type = 'purchase' buy, z.n, z.entry, z.high,
    case when g.event_type = 'purchase' or z.n = 0 then null when g.value <= case z.mode when 'fixed' then z.entry * 0.6 when 'trail' then z.high * 0.6 when 'breakeven' then case when z.high >= z.entry * 1.25 then z.entry else z.entry * 0.6 end end then 'stop' when g.value >= z.entry * 2.0 then 'take' end why
    from z join g on g.user_id = z.user_id and g.mode = z.mode and g.i = z.i + 1))
select user_id, mode, event_id, why, round(paid, 6) + 0.0 entry, v price from z where why is not null"""


@register("stream_guarded_positions", _GUARD_SQL)
def stream_guarded_positions(spark, sf_dir):
    """Positions of each user's purchases under a fixed, a trailing and a break-even stop, with a take-profit."""
    rows = _stateful(spark, lambda: events.guarded(_stream(spark, sf_dir), "purchase", stop=0.4, take=1.0, breakeven=0.25))
    return rows.withColumn("entry", F.round("entry", 6) + F.lit(0.0))


@register(
    "stream_slots_cap",
    """with e as (select *, cast(ts as date) "day" from events), f as (select "day", user_id, min(struct_pack(ts := ts, id := event_id)) at_ from e where event_type = 'purchase' group by all),
r as (select "day", user_id, at_, row_number() over (partition by "day" order by at_) n from f), full_at as (select "day", at_ from r where n = 20),
o as (select "day", user_id, min(struct_pack(ts := ts, id := event_id)) at_ from e where event_type = 'click' group by all)
select o."day", o.user_id from o join full_at u on u."day" = o."day" and o.at_ < u.at_ left join f on f."day" = o."day" and f.user_id = o.user_id and f.at_ <= u.at_ where f.user_id is null""",
)
def stream_slots_cap(spark, sf_dir):
    """Orders (clicks) still open when the day's twentieth user has bought (purchase) are cancelled."""
    return _stateful(spark, lambda: events.slots_cap(_stream(spark, sf_dir), 20, order="click", fill="purchase"))


_HOLD_SQL = f"""{_BY_USER}, z as (select user_id, i, event_id, value v, case when event_type = 'signup' then 'pending' else 'none' end state, 0.0::double entry, 0 closes, 0.0::double stop, 'none' was, case when event_type = 'signup' then 'placed' end why from e where i = 1
  union all select user_id, i, event_id, v, case why when 'placed' then 'pending' when 'filled' then 'held' when 'bought back' then 'held' when 'stop' then 'stopped' when 'unfilled' then 'none' when 'strength' then 'none' when 'last close' then 'none' when 'dropped' then 'none' else state end,
    case when why in ('filled', 'bought back') then v else entry end, case when why in ('filled', 'bought back') then 0 when k = 'view' and state = 'held' then closes + 1 else closes end, case when why in ('filled', 'bought back') then v * 0.7 else stop end, state, why
  from (select e.user_id, e.i, e.event_id, e.value v, e.event_type k, z.state, z.entry, z.closes, z.stop,
    case when z.state = 'none' and e.event_type = 'signup' then 'placed' when z.state = 'pending' and e.event_type = 'purchase' then 'filled' when z.state = 'pending' and e.event_type = 'view' then 'unfilled'
      when z.state = 'held' and e.event_type in ('error', 'click') and e.value <= z.stop then 'stop' when z.state = 'held' and e.event_type = 'view' and z.closes + 1 >= 5 then 'last close' when z.state = 'held' and e.event_type = 'view' and e.value >= z.entry * 1.5 then 'strength'
      when z.state = 'stopped' and e.event_type in ('error', 'click') and e.value >= z.stop * 1.1 then 'bought back' when z.state = 'stopped' and e.event_type = 'signup' then 'dropped' end why
    from z join e on e.user_id = z.user_id and e.i = z.i + 1))
select user_id, event_id, was, state, why, v price from z where why is not null"""


@register("stream_holds", _HOLD_SQL)
def stream_holds(spark, sf_dir):
    """Positions over several days: signup places an order, purchase fills it, view is a close, error and click are prices."""
    kinds = {"signup": "order", "purchase": "fill", "view": "close", "error": "price", "click": "price"}
    return _stateful(spark, lambda: events.holds(_stream(spark, sf_dir), kinds, stop=0.3, strength=0.5, back=0.1, closes=5))


@register("session_windows", """with g as (select *, case when ts - lag(ts) over w >= interval 6 hours or lag(ts) over w is null then 1 else 0 end z from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(z) over (partition by user_id order by ts, event_id rows unbounded preceding) i from g) select user_id, min(ts) "start", count(*) n, round(sum(value), 6) + 0.0 total from s group by user_id, i""")
def session_windows(spark, sf_dir):
    rows = source.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rnd(own.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total"), 6)


@register("json_alias_fields", "select event_id, cast(coalesce(json_extract_string(lower(props), '$.key'), json_extract_string(lower(props), '$.k')) as int) k from events")
def json_alias_fields(spark, sf_dir):
    return source.table(spark, sf_dir, "events").select("event_id", reports.field(F.col("props"), "Key", "K").cast("int").alias("k"))


_LOG = "select cast(ts as date) \"day\", 'M' || cast(user_id % 6 as varchar) market, case when event_type < 'd' then 'placed' else 'result' end kind, value x, event_id as atid from events"


@register(
    "event_log_fold",
    f"""with lg as ({_LOG}) select "day", market, max(case when kind = 'placed' and n = 1 then x end) placed, max(case when kind = 'result' and n = 1 then x end) result
from (select *, row_number() over (partition by "day", market, kind order by atid desc) n from lg) group by "day", market""",
)
def event_log_fold(spark, sf_dir):
    e = source.table(spark, sf_dir, "events")
    log = e.select(
        F.to_date("ts").alias("day"), F.concat(F.lit("M"), (F.col("user_id") % 6).cast("string")).alias("market"), F.when(F.col("event_type") < "d", "placed").otherwise("result").alias("kind"), F.col("value").alias("x"), F.col("event_id").alias("at")
    )
    return reports.fold_log(log)


_MODEL = """md as (select cast(o_orderdate as date) "day", 'M' || cast(o_custkey % 4 as varchar) market, o_custkey % 50 symbol, round(avg(o_totalprice) / 1e6, 8) ret from orders where o_orderkey % 3 <> 0 group by all),
fl as (select cast(o_orderdate as date) "day", 'M' || cast(o_custkey % 4 as varchar) market, o_custkey % 50 symbol, round(max(o_totalprice) / 1e6, 8) fill from orders where o_orderkey % 5 <> 0 group by all)"""


@register(
    "model_vs_fills",
    f"""with {_MODEL}, j as (select coalesce(md.market, fl.market) market, ret, fill from md full join fl on md."day" = fl."day" and md.market = fl.market and md.symbol = fl.symbol)
select market, count(*) filter (where ret is not null and fill is not null) "both", count(*) filter (where fill is null) model, count(*) filter (where ret is null) broker, round(avg(fill - ret), 8) + 0.0 gap from j group by market""",
)
def model_vs_fills(spark, sf_dir):
    o = source.table(spark, sf_dir, "orders")
    key = [F.to_date("o_orderdate").alias("day"), F.concat(F.lit("M"), (F.col("o_custkey") % 4).cast("string")).alias("market"), (F.col("o_custkey") % 50).alias("symbol")]
    model = o.where("o_orderkey % 3 != 0").groupBy(*key).agg(F.round(F.avg("o_totalprice") / 1e6, 8).alias("ret"))
    fills = o.where("o_orderkey % 5 != 0").groupBy(*key).agg(F.round(F.max("o_totalprice") / 1e6, 8).alias("fill"))
    return rnd(reports.match_summary(reports.against_fills(model, fills)))


@register(
    "symbol_trades",
    """with f as (select l_suppkey symbol, case when l_returnflag = 'A' then 'S' else 'B' end side, l_quantity qty, l_extendedprice / 100 price, 0.5 fee, cast(l_shipdate as date) d from lineitem),
g as (select symbol, sum(case when side = 'B' then qty else 0 end) bought, sum(case when side = 'S' then qty else 0 end) sold, sum(case when side = 'B' then qty * price else 0 end) paid, sum(case when side = 'S' then qty * price else 0 end) got, sum(fee) fee, max(case when side = 'S' then d end) sold_at from f group by symbol)
select symbol, bought, sold, round(paid / bought, 4) buy_price, round(got / sold, 4) sell_price, round(least(bought, sold) * (got / sold - paid / bought) - fee, 2) + 0.0 pnl, round(fee, 4) fee, sold_at from g""",
)
def symbol_trades(spark, sf_dir):
    li = source.table(spark, sf_dir, "lineitem")
    fills = li.select(
        F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "A", "S").otherwise("B").alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / 100).alias("price"), F.lit(0.5).alias("fee"), F.to_date("l_shipdate").alias("at")
    )
    out = reports.symbol_trades(fills).withColumnRenamed("sold_at", "sold_at")
    return rnd(out.withColumn("pnl", F.round("pnl", 2)), 4)


@register("last_bars", sql.query(sql.bars(), "select ticker, d, round(c, 6) + 0.0 c from (select *, row_number() over (partition by ticker order by d desc) n from bars) where n <= 20"))
def last_bars(spark, sf_dir):
    return rnd(reports.last_bars(bars(spark, sf_dir).select("ticker", "d", "c"), 20), 6)


@register("html_ticker_extract", """select code, count(*) pages from (select distinct page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]{2,6})"', 1)) code from pages) group by code""")
def html_ticker_extract(spark, sf_dir):
    return reports.tickers_of(source.table(spark, sf_dir, "pages"))


@register("book_changes", """with b as (select o_custkey % 4 market, cast(o_orderdate as date) "day", list(struct_pack(t := o_custkey % 3, l := round(floor(o_totalprice / 100000), 6)) order by o_custkey % 3, floor(o_totalprice / 100000)) book from orders group by all)
select market, "day", coalesce(book <> lag(book) over (partition by market order by "day"), true) changed from b""")
def book_changes(spark, sf_dir):
    o = source.table(spark, sf_dir, "orders")
    return reports.changed_books(o.select((F.col("o_custkey") % 4).alias("market"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 3).alias("ticker"), F.floor(F.col("o_totalprice") / 100000).cast("double").alias("lim")))


@register("field_fill_counts", "select 'c_acctbal' field, count(*) filter (where c_acctbal is not null and c_acctbal <> 0) filled from customer union all select 'c_mktsegment', count(*) filter (where c_mktsegment <> '') from customer")
def field_fill_counts(spark, sf_dir):
    return reports.fill_counts(source.table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")


@register("fx_last_rates", sql.query(sql.bars("p_type"), "select ticker pair, last(d order by d) d, round(last(c order by d), 6) + 0.0 rate from bars group by ticker"))
def fx_last_rates(spark, sf_dir):
    return rnd(bars_by_type(spark, sf_dir).groupBy(F.col("ticker").alias("pair")).agg(F.max("d").alias("d"), F.max_by("c", "d").alias("rate")), 6)


def bars_by_type(spark, sf_dir):
    return bars(spark, sf_dir, "p_type")


@register("lowest_low_20", sql.query(sql.bars(), "select ticker, d, round(min(l) over (partition by ticker order by d rows 19 preceding), 6) + 0.0 low from bars"))
def lowest_low_20(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("d").rowsBetween(-19, 0)
    return rnd(bars(spark, sf_dir).select("ticker", "d", F.min("l").over(w).alias("low")), 6)


@register("track_record", sql.query(sql.bars("p_type"), """select ticker, count(*) n, round(exp(sum(ln(c / p))) - 1, 8) + 0.0 total from (select *, lag(c) over (partition by ticker order by d) p from bars)
where p is not null and d > (select max(b) from (select min(d) b from bars group by ticker)) group by ticker""".replace("select ticker", " select ticker", 1)))
def track_record(spark, sf_dir):
    """Compound return of each series since the latest common start."""
    b = bars_by_type(spark, sf_dir)
    start = b.groupBy("ticker").agg(F.min("d").alias("b")).agg(F.max("b").alias("since"))
    rows = b.withColumn("p", F.lag("c").over(Window.partitionBy("ticker").orderBy("d"))).where("p is not null").join(F.broadcast(start), F.col("d") > F.col("since"))
    return rnd(rows.groupBy("ticker").agg(F.count("*").alias("n"), F.expm1(F.sum(F.log(F.col("c") / F.col("p")))).alias("total")))


_WHOLE = ORACLE["order_list_net"]


def _in_parts(spark, sf_dir):
    """The order list with its shares as whole hundred-millionths, which every engine writes alike."""
    parts = lambda c: F.round(F.col(c) * 1e8).cast("long").alias(c)
    return order_list_net(spark, sf_dir).select("t", "place", "ticker", parts("gross"), parts("cost"))


_PART = "struct_pack(place := place, ticker := ticker, gross := cast(round(gross * 1e8) as bigint), cost := cast(round(cost * 1e8) as bigint))"


@register("order_report_json", f"select t, cast(to_json(struct_pack(n := count(*), orders := list({_PART} order by place))) as varchar) report from ({_WHOLE}) group by t")
def order_report_json(spark, sf_dir):
    return reports.report_json(_in_parts(spark, sf_dir))


@register("order_book_json", f"""with b as ({_WHOLE}), u as (select t, list(struct_pack(ticker := ticker, keep := place % 2 = 0) order by ticker) u from b where t % 2 = 0 group by t)
select t, cast(to_json(struct_pack(orders := o, updates := coalesce(u, []))) as varchar) book from (select t, list({_PART} order by place) o from b group by t) left join u using (t)""")
def order_book_json(spark, sf_dir):
    rows = _in_parts(spark, sf_dir)
    return reports.book_json(rows, rows.where("t % 2 = 0").select("t", "ticker", (F.col("place") % 2 == 0).alias("keep")))


@register("order_report_text", f"select t, count(*) || ' orders' || chr(10) || string_agg(printf('%d. %s, expected %.2f%%, costs %.2f%%', place + 1, ticker, 100 * gross, 100 * cost), chr(10) order by place) report from ({_WHOLE}) group by t")
def order_report_text(spark, sf_dir):
    return reports.report_text(order_list_net(spark, sf_dir))


RUNS = {
    "plain": backtest.Settings(),
    "psar": backtest.Settings(psar=True, rebuy=0.0),
    "psarvol": backtest.Settings(psarvol=3.0, refill=True),
    "vstop": backtest.Settings(vstop=3.0, rebuystop=0.01),
    "stop5": backtest.Settings(stop=0.05, rebuy=0.01),
    "median": backtest.Settings(psarvol=3.0, rebuystop=0.01, stopmedian=True),
}


@register("backtest_stateful")
def backtest_stateful(spark, sf_dir):
    """Daily returns of five runs with and without stops, each a group of its own."""
    return rnd(backtest.backtests(universe(spark, sf_dir), ranking(spark, sf_dir, "momentum"), RUNS))


@register("backtest_stateful_trades")
def backtest_stateful_trades(spark, sf_dir):
    return rnd(backtest.backtests(universe(spark, sf_dir), ranking(spark, sf_dir, "momentum"), RUNS, "trades"))


@register("backtest_stateful_orders")
def backtest_stateful_orders(spark, sf_dir):
    """Every order of the five runs, filled or not."""
    return rnd(backtest.backtests(universe(spark, sf_dir), ranking(spark, sf_dir, "momentum"), RUNS, "orders"))


@register("allocate_markets")
def allocate_markets(spark, sf_dir):
    return rnd(models.allocation(daily_by_k(spark, sf_dir).select(F.col("k").cast("string").alias("market"), "u", "ret")))


@register("regimes")
def regimes(spark, sf_dir):
    market = panel.market_return(universe(spark, sf_dir)).where("mkt is not null")
    return models.regimes(market, ranking(spark, sf_dir, "momentum").select(F.col("t").alias("t0")).distinct())


def _clamped(column: str, low: float, high: float) -> str:
    return f"least({high}, greatest({low}, coalesce({column}, 0)))"


_INPUTS = [
    *(f"coalesce(case when {c} is not null and count({c}) over (partition by t) > 1 then (row_number() over (partition by t order by {c} nulls last, ticker) - 1) / (count({c}) over (partition by t) - 1) - 0.5 end, 0)" for c in neural.RANKED),
    *(_clamped(*c) for c in (("mkt12", -1.0, 1.0), ("mktvol * 10", 0.0, 1.0), ("m12", -1.0, 1.0), ("m1", -0.5, 0.5), ("w1", -0.3, 0.3), ("high", -1.0, 0.0), ("sigma * 10", 0.0, 1.0))),
    "1.0",
]


@register(
    "nn_samples",
    sql.query(
        sql.universe(),
        f""", nf as (select t, ticker, tradable, value, sigma, {sql.change(252, 21)} m12, {sql.change(126, 21)} m6, {sql.change(21)} m1, {sql.change(5)} w1, stddev_pop(ret) {sql.back(63)} vol63, stddev_pop(ret) {sql.back(252)} vol252,
  cf / max(cf) {sql.back(252)} - 1 high, sum(mkt) {sql.back(252)} mkt12, stddev_pop(mkt) {sql.back(63)} mktvol, ln(lead(cf, 21) over w / cf) y from pan window w as {sql.BY}), ok as (select * from nf where tradable and t >= 260 and (t - 260) % 21 = 0)
select t, ticker, t + 21 ready, round(y, 6) + 0.0 y, round(sigma, 6) + 0.0 sigma, {', '.join(f'round(cast(cast({e} as float) as double), 4) + 0.0 x{i}' for i, e in enumerate(_INPUTS))} from ok""",
    ),
)
def nn_samples(spark, sf_dir):
    rows = neural.samples(with_market(spark, sf_dir))
    number = lambda c, n: F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), n) + F.lit(0.0)
    inputs = [number(F.col("x")[i], 4).alias(f"x{i}") for i in range(len(_INPUTS))]
    return rows.select("t", "ticker", "ready", number("y", 6).alias("y"), number("sigma", 6).alias("sigma"), *inputs)


@register("nn_walk_forward")
def nn_walk_forward(spark, sf_dir):
    return rnd(neural.walk_forward(neural.samples(with_market(spark, sf_dir))))


def _candidates(spark, sf_dir):
    top = ranking(spark, sf_dir, "momentum").where("rank < 6")
    return top.select(F.col("t").alias("t0"), "ticker")


@register("mc_stops")
def mc_stops(spark, sf_dir):
    """Each candidate over drawn sessions with a volatility stop."""
    p = with_market(spark, sf_dir)
    return rnd(montecarlo.simulate(p, _candidates(spark, sf_dir), backtest.Settings(psarvol=3.0)))


@register("mc_choose")
def mc_choose(spark, sf_dir):
    return montecarlo.chosen(mc_stops(spark, sf_dir), 3, by_growth=True)


@register("mc_settings")
def mc_settings(spark, sf_dir):
    """The stop multiple with the best simulated mean, by ticker, and what most of a reset's tickers chose."""
    p = with_market(spark, sf_dir)
    c = _candidates(spark, sf_dir)
    runs = [montecarlo.simulate(p, c, backtest.Settings(psarvol=float(m))).withColumn("setting", F.lit(m)) for m in (2, 3, 6)]
    best = montecarlo.best_settings(runs[0].unionByName(runs[1]).unionByName(runs[2]))
    return best.join(F.broadcast(montecarlo.voted(best).withColumnRenamed("setting", "voted")), "t0")
