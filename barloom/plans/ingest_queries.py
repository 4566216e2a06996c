"""Queries over ingestion, order selection and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalars
from barloom.operators import clean, ingest, reports, strategies
from barloom.plans import sql
from barloom.plans.evaluation_queries import _BT, _TRADES, backtest, closed_trades
from barloom.plans.panel_queries import bars, ranking, register, rnd
from barloom.sources import bars as source

_SCALARS = """select o_orderkey, cast(d - case dayofweek(d) when 1 then 3 when 0 then 2 else 1 end as date) before, regexp_replace(o_orderpriority, '[^A-Za-z0-9.-]', '_', 'g') name, least(200000.0, greatest(50000.0, o_totalprice)) clamped,
  split_part(o_orderpriority, '-', 1) code, last_day(d) month_end, cast(d + interval 1 month as date) later from (select *, cast(o_orderdate as date) d from orders)"""


@register("scalar_functions", _SCALARS)
def scalar_functions(spark, sf_dir):
    o = source.table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select(
        "o_orderkey", scalars.previous_weekday(F.col("d")).alias("before"), scalars.safe_name(F.col("o_orderpriority")).alias("name"), scalars.clamp(F.col("o_totalprice"), 50000.0, 200000.0).alias("clamped"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("code"), F.last_day("d").alias("month_end"), F.add_months("d", 1).alias("later"),
    )


@register("utf8_prefix", "select doc_id, strlen(x) n, x from (select doc_id, left(text, k) x from (select doc_id, text, (select max(k) from range(0, 31) r(k) where strlen(left(text, k)) <= 30) k from documents))")
def utf8_prefix(spark, sf_dir):
    d = source.table(spark, sf_dir, "documents").select("doc_id", scalars.first_bytes(F.col("text"), 30).alias("x"))
    return d.select("doc_id", F.octet_length("x").cast("long").alias("n"), "x")


@register("market_close_utc", """select distinct cast(ts as date) "day", timezone('UTC', timezone('Europe/London', cast(cast(ts as date) as timestamp) + interval '16 hours 30 minutes')) closes from events""")
def market_close_utc(spark, sf_dir):
    d = source.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return d.select("day", scalars.close_utc(F.col("day"), 16, 30, "Europe/London").cast("timestamp_ntz").alias("closes"))


@register("most_traded_today", sql.query(sql.bars(), 'select d, ticker, place from (select d, ticker, row_number() over (partition by d order by c * v desc, ticker) - 1 "place" from bars) x(d, ticker, place) where place < 5'))
def most_traded_today(spark, sf_dir):
    return ingest.most_traded_today(bars(spark, sf_dir), 5).select("d", "ticker", "place")


@register("infer_splits")
def infer_splits(spark, sf_dir):
    """Bars with a two-for-one split put into one ticker, read back from prices and volumes."""
    b = bars(spark, sf_dir)
    before = (F.col("d") < F.lit("1998-03-03").cast("date")) & (F.col("ticker") == "Brand#11")
    k = F.when(before, 2.0).otherwise(1.0)
    broken = b.select("ticker", "d", *((F.col(x) * k).alias(x) for x in "ohlc"), (F.col("v") / F.when(before, 8.0).otherwise(1.0)).alias("v"))
    return rnd(ingest.infer_splits(broken), 6)


@register(
    "join_history",
    sql.query(
        sql.bars("p_type") + """, sh as (select * from bars where ticker not like 'ECONOMY%' or d >= date '2000-01-01'), ot as (select *, case when day(d) % 2 = 0 then 1 else 2 end pref from bars where ticker like 'ECONOMY%'),
ct as (select ticker, count(*) n, min(d) b from sh group by ticker having count(*) < 900), mo as (select ot.* from ot join ct using (ticker) where d < b), bs as (select ticker, min(pref) pref from mo group by ticker)""",
        "select ticker, d, round(c, 6) + 0.0 c from (select ticker, d, c from sh union all select mo.ticker, mo.d, mo.c from mo join bs using (ticker, pref))",
    ),
)
def join_history(spark, sf_dir):
    b = bars(spark, sf_dir, "p_type").select("ticker", "d", "c")
    economy = F.col("ticker").startswith("ECONOMY")
    others = b.where(economy).withColumn("pref", F.when(F.dayofmonth("d") % 2 == 0, 1).otherwise(2))
    return rnd(clean.join_history(b.where(~economy | (F.col("d") >= F.lit("2000-01-01").cast("date"))), others, 900), 6)


@register("share_classification", "select p_partkey, p_type like '%BRASS' or p_type like '%COPPER' ord from part")
def share_classification(spark, sf_dir):
    p = source.table(spark, sf_dir, "part")
    metal = F.when(F.col("p_type").rlike("BRASS$|COPPER$"), "EQ").otherwise("ETF")
    return p.select("p_partkey", ingest.ordinary(F.col("p_type"), metal).alias("ord"))


@register("still_wanted", sql.query(sql.bars(), "select distinct ticker from bars where ticker not in (select ticker from bars where v > 100 and date '2001-11-04' - d < 3)"))
def still_wanted(spark, sf_dir):
    b = bars(spark, sf_dir)
    return ingest.still_wanted(b.select("ticker").distinct(), b.where("v > 100").select("ticker", F.col("d").alias("seen")), F.lit("2001-11-04").cast("date"), 3)


@register(
    "profiles",
    """select c_custkey code, c_name name, n_name sector, price, orders from customer
left join (select c_custkey code, n_name from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 <> 0) p on p.code = c_custkey
left join (select o_custkey code, last(round(o_totalprice, 2) order by o_orderkey) price, last(o_orderkey order by o_orderkey) orders from orders group by o_custkey) f on f.code = c_custkey""",
)
def profiles(spark, sf_dir):
    t = lambda n: source.table(spark, sf_dir, n)
    c = t("customer")
    names = c.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    sector = c.where("c_custkey % 3 != 0").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("code"), F.col("n_name").alias("sector"), F.lit(0).alias("at"))
    fund = t("orders").select(F.col("o_custkey").alias("code"), F.round("o_totalprice", 2).alias("price"), F.col("o_orderkey").alias("orders"), F.col("o_orderkey").alias("at"))
    return ingest.profiles(names, sector, fund)


@register("symbol_search", "select p_partkey code, p_name name from part where upper(cast(p_partkey as varchar)) like '12%' or upper(cast(p_partkey as varchar)) like '7%'")
def symbol_search(spark, sf_dir):
    p = source.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"))
    return ingest.find(p, "12", "7").withColumn("code", F.col("code").cast("long"))


@register(
    "intraday_snapshot",
    """with s as (select event_type ticker, time_bucket(interval 5 minutes, ts) w, max(value) h, count(*) n from events group by all)
select cast(date_trunc('month', w) as date) "month", ticker, cast(w as date) "day", count(*) slots, sum(n) n, round(max(h), 6) h from s group by all""",
)
def intraday_snapshot(spark, sf_dir):
    e = source.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"), F.col("event_id").alias("at"))
    s = ingest.snapshots(e)
    total = lambda f: F.aggregate(F.transform("rows", lambda x: x[f]), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("month", "ticker", "day", F.size("rows").cast("long").alias("slots"), total("n").cast("decimal(38,0)").alias("n"), F.round(F.array_max(F.transform("rows", lambda x: x["h"])), 6).alias("h"))


@register("recently_placed", "select distinct 'X' || cast(user_id % 3 as varchar) || ':' || cast(user_id as varchar) ticker from events where event_type < 'd' and cast(ts as date) >= date '2024-01-20' and user_id not in (select user_id from events where value > 195)")
def recently_placed(spark, sf_dir):
    e = source.table(spark, sf_dir, "events")
    log = e.select(F.to_date("ts").alias("day"), F.when(F.col("event_type") < "d", "placed").otherwise("result").alias("kind"), F.concat(F.lit("X"), (F.col("user_id") % 3).cast("string"), F.lit(":"), F.col("user_id").cast("string")).alias("ticker"))
    return ingest.recently_placed(log, e.where("value > 195").select(F.col("user_id").cast("string").alias("code")).distinct(), F.lit("2024-01-20").cast("date"))


@register("coverage_by_exchange", "select 'E' || cast(p_partkey % 5 as varchar) exchange, count(*) pool, count(x) with_bars from part left join (select distinct l_partkey x from lineitem where l_quantity > 48) on x = p_partkey group by 1")
def coverage_by_exchange(spark, sf_dir):
    name = lambda c: F.concat(F.lit("E"), (F.col(c) % 5).cast("string"), F.lit(":"), F.col(c).cast("string")).alias("ticker")
    return ingest.coverage(source.table(spark, sf_dir, "part").select(name("p_partkey")), source.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(name("l_partkey")))


@register("bars_by_code", sql.query(sql.bars("p_type"), "select ticker, d from bars where ticker = (select min(ticker) from bars)"))
def bars_by_code(spark, sf_dir):
    b = bars(spark, sf_dir, "p_type")
    first = b.agg(F.min("ticker")).first()[0]
    return ingest.by_ticker_or_code(b, f"LON:{first}").select("ticker", "d")


@register("tick_rounding", "select o_orderkey, case when o_totalprice >= 200000 then 100.0 when o_totalprice >= 100000 then 50.0 when o_totalprice >= 1000 then 5.0 else 0.5 end tick, floor(o_totalprice / case when o_totalprice >= 200000 then 100.0 when o_totalprice >= 100000 then 50.0 when o_totalprice >= 1000 then 5.0 else 0.5 end + 1e-9) * case when o_totalprice >= 200000 then 100.0 when o_totalprice >= 100000 then 50.0 when o_totalprice >= 1000 then 5.0 else 0.5 end rounded from (select o_orderkey, cast(o_totalprice as double) o_totalprice from orders)")
def tick_rounding(spark, sf_dir):
    bands = spark.createDataFrame([(0.0, 0.5), (1000.0, 5.0), (100000.0, 50.0), (200000.0, 100.0)], "low double, tick double")
    o = ingest.tick_size(source.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), bands)
    return o.select("o_orderkey", "tick", (F.floor(F.col("price") / F.col("tick") + 1e-9) * F.col("tick")).alias("rounded"))


@register(
    "outlook_delivered",
    sql.query(
        _BT + _TRADES + """, tt as (select * from trd where closed is not null), ww as (select ret, power(0.5, (dense_rank() over (order by opened desc) - 1) / 10.0) w from tt where ticker <> 'Brand#11'),
kk as (select least(1, greatest(0, sum(w * ret) / sum(w * 0.004))) delivered from ww), ee as (select sum((0.001 + length(ticker) * 0.0005) / greatest(1, closed - opened)) / 5 expected from tt where opened > 2400)""",
        "select round(expected, 8) expected, round(delivered, 8) + 0.0 delivered, round(expected * delivered, 8) + 0.0 outlook from ee, kk",
    ),
)
def outlook_delivered(spark, sf_dir):
    t = closed_trades(spark, sf_dir).where("closed is not null")
    orders = t.where("opened > 2400").select((0.001 + F.length("ticker") * 0.0005).alias("expected"), (F.col("closed") - F.col("opened")).cast("double").alias("hold"))
    trades = t.select(F.col("opened").alias("d"), F.lit(0.004).alias("expected"), "ret", (F.col("ticker") != "Brand#11").alias("filled"))
    return rnd(ingest.outlook(orders, trades, 5))


_STATE = """with o as (select o_custkey symbol, bool_or(o_orderstatus = 'F') refused, bool_or(o_orderstatus = 'O') opn from orders where o_orderkey % 2 = 0 group by 1),
f as (select l_suppkey symbol, sum(case when l_returnflag = 'N' then l_quantity else 0 end) b, sum(case when l_returnflag = 'A' and l_quantity > 49 and l_linenumber = 1 then l_quantity else 0 end) s from lineitem group by 1),
h as (select s_suppkey symbol, max(s_nationkey % 3) dys from supplier group by 1)
select coalesce(o.symbol, f.symbol, h.symbol) symbol, case when coalesce(s, 0) > 0 then 'sold' when coalesce(dys, 0) > 0 then 'held' when coalesce(b, 0) > 0 then 'bought' when coalesce(refused, false) then 'refused' when coalesce(opn, false) then 'waiting' else 'none' end state
from o full join f on o.symbol = f.symbol full join h on coalesce(o.symbol, f.symbol) = h.symbol"""


@register("trade_states", _STATE)
def trade_states(spark, sf_dir):
    t = lambda n: source.table(spark, sf_dir, n)
    orders = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("symbol"), F.when(F.col("o_orderstatus") == "F", "refused").when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"))
    sale = (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 49) & (F.col("l_linenumber") == 1)
    fills = t("lineitem").select(F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "N", "B").when(sale, "S").otherwise("-").alias("side"), F.col("l_quantity").alias("qty"))
    return ingest.states(orders, fills, t("supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") % 3).alias("days")))


@register("stream_selection", sql.query(sql.scored("momentum"), ", l as (select max(t) m from ranked), o as (select ticker, rank, 0 late from ranked, l where t = m and rank between 3 and 5 union all select ticker, rank, 1 from ranked, l where t = m), f as (select ticker, min(struct_pack(late := late, rank := rank)) at_ from o group by ticker) select ticker, at_.late as late, at_.rank as rank from f order by at_, ticker limit 8"))
def stream_selection(spark, sf_dir):
    r = ranking(spark, sf_dir, "momentum")
    last = r.join(F.broadcast(r.agg(F.max("t").alias("t"))), "t")
    return ingest.selected(last.where("rank between 3 and 5"), last, 8)


@register(
    "orders_by_stop_distance",
    sql.query(
        sql.scored("momentum"),
        ", x as (select r.t, r.ticker, r.rank, round(1.5 * p.sigma, 8) distance, round(r.score / 12, 8) net, r.rank % 4 = 0 held, 1.0 / (1 + r.rank) fill from ranked r join pan p using (t, ticker) where r.rank < 10), m as (select *, list_sort(list(distance) over (partition by t)) al from x), k as (select * from m where held or distance <= al[cast(floor(len(al) / 2) as int) + 1]) select t, ticker, distance, row_number() over (partition by t order by fill * net / greatest(0.005, distance) desc, ticker) - 1 as place from k",
    ),
)
def orders_by_stop_distance(spark, sf_dir):
    top = ranking(spark, sf_dir, "momentum").where("rank < 10")
    rows = top.select("t", "ticker", F.round(1.5 * F.col("sigma"), 8).alias("distance"), F.round(F.col("score") / 12, 8).alias("net"), (F.col("rank") % 4 == 0).alias("held"), (1.0 / (1 + F.col("rank"))).alias("fill"))
    return ingest.by_stop_distance(rows).select("t", "ticker", "distance", "place")


@register("next_session_updates", sql.query(_BT, "select ticker, bool_or(k) keep from (select ticker, true k from ranked where t = (select max(t) from ranked) and rank < 5 union all select ticker, false from (select ticker, max(u) last_held from ch where now = 1 group by ticker) where last_held >= 2200) group by ticker"))
def next_session_updates(spark, sf_dir):
    r = ranking(spark, sf_dir, "momentum")
    target = r.join(F.broadcast(r.agg(F.max("t").alias("t"))), "t").where("rank < 5")
    flow = backtest(spark, sf_dir).where("change is not null and exit is null").groupBy("ticker").agg(F.max("u").alias("last_held"))
    return ingest.updates(target, flow, 2460, 260)


_SAID = {
    "momentum": "printf('rose %.1f%% in the year before the last month', 100 * score)",
    "trend": "printf('gained %.2f times its yearly volatility', score)",
    "lowvol": "printf('moves %.2f%% a day, among the least', -100 * score)",
    "reversal": "printf('fell %.2f volatilities more in a week than the market explains', score)",
    "resmom": "printf('beat the market by %.2f standard errors in the year before the last month', score)",
    "high52": "printf('closes %.1f%% below its highest of a year', 100 * (1 - score))",
    "lowmax": "printf('gained at most %.2f%% on any day of a month', 100 * (exp(-score) - 1))",
    "ltrev": "printf('moved %.1f%% in the three years to a year ago', -100 * score)",
}


def _reasons(name: str) -> None:
    @register(f"{name}_reasons", sql.query(sql.scored(name), f"select t, ticker, {_SAID[name]} reason from ranked where rank < 3"))
    def reasons(spark, sf_dir):
        top = ranking(spark, sf_dir, name).where("rank < 3")
        return top.select("t", "ticker", strategies.reason(name, F.col("score")).alias("reason"))


for _name in _SAID:
    _reasons(_name)


@register("fx_cross_rates", sql.query(sql.bars("p_type"), """, r as (select ticker, round(last(c order by d), 6) c from bars where ticker in ('ECONOMY', 'LARGE', 'MEDIUM') group by ticker),
g as (select max(case when ticker = 'ECONOMY' then c end) g, max(case when ticker = 'LARGE' then c end) d, max(case when ticker = 'MEDIUM' then c end) a from r)
select 'EUR' currency, 1.0::double rate union all select 'GBP', g from g union all select 'USD', round(g * d, 6) from g union all select 'AUD', a from g"""))
def fx_cross_rates(spark, sf_dir):
    b = bars(spark, sf_dir, "p_type")
    pair = F.create_map(*(F.lit(x) for kv in (("ECONOMY", "EURGBP"), ("LARGE", "GBPUSD"), ("MEDIUM", "EURAUD")) for x in kv))[F.col("ticker")]
    last = b.groupBy(pair.alias("pair")).agg(F.round(F.max_by("c", "d"), 6).alias("rate"))
    return rnd(ingest.cross_rates(last), 6)


@register("distinct_segments", "select c_nationkey, count(*) n, count(distinct nullif(c_mktsegment, '')) c_mktsegment, count(distinct nullif(c_name, '')) c_name from customer group by c_nationkey")
def distinct_segments(spark, sf_dir):
    return ingest.distinct_values(source.table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_name")


_JOBS = "select c_custkey job, c_custkey * 7 % 1440 \"at\", case when c_custkey % 3 > 0 then 100 - c_custkey % 3 // 2 end done_day, c_nationkey % 5 tries, 600 + c_custkey % 120 last_try from customer"


@register("jobs_due", f"""with j as ({_JOBS}) select job, "at", tries from j where "at" <= 700 and coalesce(done_day, -1) < 100 and (tries = 0 or tries < 3 and last_try + 10 <= 700)""")
def jobs_due(spark, sf_dir):
    c = source.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    jobs = c.select(k.alias("job"), (k * 7 % 1440).alias("at"), F.when(k % 3 > 0, 100 - F.floor(k % 3 / 2)).alias("done_day"), (F.col("c_nationkey") % 5).alias("tries"), (600 + k % 120).alias("last_try"))
    return ingest.due(jobs, 100, 700).select("job", "at", "tries")


@register(
    "broker_history",
    """with x as (select 'C' || cast(o_custkey % 3 as varchar) currency, cast(o_orderdate as date) "day", o_orderstatus = 'F' filled, case when o_orderkey % 4 > 0 then o_orderstatus <> 'P' end mf, (o_totalprice % 100 - 50) / 1000 ret, o_totalprice % 1000 - 480 pnl,
  100 + o_totalprice % 7 mp, (100 + o_totalprice % 5) * case o_orderkey % 3 when 0 then 1 when 1 then 100 else 0.01 end paid, (o_totalprice % 90 - 45) / 1000 mr from orders),
g as (select *, case when filled and mf then paid / mp end r from x),
u as (select *, case when r is not null then r / case when abs(ln(r)) <= abs(ln(r / 0.01)) and abs(ln(r)) <= abs(ln(r / 100)) then 1 when abs(ln(r / 0.01)) <= abs(ln(r / 100)) then 0.01 else 100 end - 1 end gap from g)
select currency, "day", count(*) orders, count(*) filter (where filled) bought, count(*) filter (where filled and ret > 0) wins, round(sum(case when filled then pnl else 0 end), 4) + 0.0 pnl, count(*) filter (where mf is not null) checked,
  count(*) filter (where mf is not null and filled = mf) agree, round(avg(gap), 8) + 0.0 gap, round(avg(case when filled and mf then ret end), 8) + 0.0 ret, round(avg(case when filled and mf then mr end), 8) + 0.0 model_ret from u group by "day", currency""",
)
def broker_history(spark, sf_dir):
    o, price = source.table(spark, sf_dir, "orders"), F.col("o_totalprice")
    unit = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 100.0).otherwise(0.01)
    rows = o.select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 3).cast("string")).alias("currency"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("filled"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus") != "P").alias("model_filled"),
        ((price % 100 - 50) / 1000).alias("ret"), (price % 1000 - 480).alias("pnl"), (100 + price % 7).alias("entry"), ((100 + price % 5) * unit).alias("paid"), ((price % 90 - 45) / 1000).alias("model_ret"),
    )
    out = reports.broker_history(rows, "currency", "day")
    return rnd(out.withColumn("pnl", F.round("pnl", 4)))


@register("order_results", sql.query(_BT + _TRADES, ", od as (select opened, avg(case when ticker <> 'Brand#11' then ret else 0 end) m, count(*) n, count(*) filter (where ticker <> 'Brand#11') f from trd group by opened) select round(avg(m), 8) + 0.0 daily, round(power(1 + avg(m), 252) - 1, 6) + 0.0 annual, round(avg(n), 8) orders, round(sum(f) / sum(n), 8) fill from od"))
def order_results(spark, sf_dir):
    t = closed_trades(spark, sf_dir).select(F.col("opened").alias("day"), "ret", (F.col("ticker") != "Brand#11").alias("filled"))
    out = reports.order_results(t)
    return rnd(out.withColumn("annual", F.round("annual", 6)))


@register(
    "totals_by_currency",
    """select n_regionkey currency, round(sum(case when o_orderstatus in ('F', 'O') then o_totalprice / 1000 else 0 end), 4) total, count(*) filter (where o_orderstatus = 'F') bought, count(*) filter (where o_orderstatus = 'O') held, count(*) filter (where o_orderstatus = 'P') waiting
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""",
)
def totals_by_currency(spark, sf_dir):
    t = lambda n: source.table(spark, sf_dir, n)
    state = F.when(F.col("o_orderstatus") == "F", "bought").when(F.col("o_orderstatus") == "O", "held").otherwise("waiting")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.col("n_regionkey").alias("currency"), state.alias("state"), (F.col("o_totalprice") / 1000).alias("pnl"), F.lit(None).cast("double").alias("open"))
    return rnd(reports.totals(rows), 4)


@register("expected_buys", sql.query(sql.scored("momentum"), "select round(sum(1.0 / (1 + rank)), 8) buys, round(avg(rank * 2.0), 8) hold from ranked where rank < 5"))
def expected_buys(spark, sf_dir):
    top = ranking(spark, sf_dir, "momentum").where("rank < 5")
    return rnd(reports.expected_buys(top.select((1.0 / (1 + F.col("rank"))).alias("fill"), (F.col("rank") * 2.0).alias("hold"))))


@register("next_stop_levels", sql.query(sql.scored("momentum"), "select r.t, r.ticker, round(cf * (1 - least(0.5, greatest(0.02, 3 * coalesce(sigma, 0.02)))), 6) stop from ranked r join pan p using (t, ticker) where r.rank < 5"))
def next_stop_levels(spark, sf_dir):
    top = ranking(spark, sf_dir, "momentum").where("rank < 5")
    rows = top.select("t", "ticker", F.col("cf").alias("close"), "sigma", F.lit(None).cast("double").alias("level"))
    return rnd(reports.stop_levels(rows, vol=3.0).select("t", "ticker", "stop"), 6)
