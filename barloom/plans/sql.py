"""Pieces of the SQL that states the queries for another engine: common table expressions that build on each other."""

from __future__ import annotations


def trades(key: str = "p_brand") -> str:
    return f"""li as (select {key} ticker, cast(l_shipdate as date) d, 100 * (1 + l_tax - l_discount) + 0.01 * l_quantity price, l_quantity qty,
  l_orderkey a, l_linenumber b, l_partkey e, l_suppkey f from lineitem join part on l_partkey = p_partkey)"""


def bars(key: str = "p_brand") -> str:
    order = "a, b, e, f, price, qty"
    return f"""{trades(key)}, bars as (select ticker, d, first(price order by {order}) o, max(price) h, min(price) l,
  last(price order by {order}) c, sum(qty) v from li group by ticker, d)"""


def panel(key: str = "p_brand", source: str = "bars") -> str:
    return f"""{bars(key)}, cal as (select d, row_number() over (order by d) - 1 t from (select distinct d from {source})),
panel as (select t, cal.d, k.ticker, o, h, l, c, v from cal cross join (select distinct ticker from {source}) k
  left join {source} b on b.d = cal.d and b.ticker = k.ticker)"""


BY = "(partition by ticker order by t)"


def carried(key: str = "p_brand", roll: int = 5) -> str:
    return f"""{panel(key)}, cf0 as (select *, last_value(c ignore nulls) over w lc, max(case when c is not null then t end) over w lt,
  min(case when c is not null then t end) over w first_t from panel window w as (partition by ticker order by t rows unbounded preceding)),
cf as (select * exclude (lc, lt), case when t - lt <= {roll} then lc end cf from cf0)"""


def returns(key: str = "p_brand") -> str:
    return f"""{carried(key)}, ret0 as (select *, last_value(cf ignore nulls) over (partition by ticker order by t rows between unbounded preceding and 1 preceding) pcf from cf),
ret as (select * exclude (pcf), case when cf > 0 and pcf > 0 then ln(cf / pcf) end ret from ret0)"""


def features(key: str = "p_brand") -> str:
    return f"""{returns(key)}, cnt as (select *, count(ret) over w n, case when c is not null and v >= 0 then c * v end x,
  count(case when c is not null and v >= 0 then 1 end) over w m from ret window w as (partition by ticker order by t rows unbounded preceding)),
feat as (select t, d, ticker, o, h, l, c, v, cf, ret, first_t,
  case when count(ret) over r >= 40 then stddev_pop(ret) over r end sigma,
  case when c is not null and count(x) over q = 20 then list_sort(list(x) filter (where x is not null) over q)[11] end value
  from cnt window r as (partition by ticker order by n range between 59 preceding and current row),
  q as (partition by ticker order by m range between 19 preceding and current row))"""


def universe(key: str = "p_brand", min_price: float = 90, min_value: float = 500, warmup: int = 260) -> str:
    return f"""{features(key)}, uni as (select *, coalesce(c >= {min_price} and t >= first_t + {warmup} and sigma > 1e-12 and value >= {min_value}, false) tradable from feat),
mkt as (select t, d, coalesce(avg(case when tradable then ret end), 0) mkt from uni group by t, d),
pan as (select uni.*, mkt.mkt from uni join mkt using (t))"""


_CH = "case when lag(cf, {a}) over w > 0 and {y} > 0 then {y} / lag(cf, {a}) over w - 1 end"


def change(a: int, b: int = 0) -> str:
    return _CH.format(a=a, y=f"lag(cf, {b}) over w" if b else "cf")


def sums(n: int, skip: int = 0) -> str:
    """Named sums over the sessions with a return."""
    f = f"over (partition by ticker order by t rows between {n - 1 + skip} preceding and {skip} preceding)"
    one = lambda e: f"sum(case when ret is not null then {e} end) {f}"
    return f"cast(count(ret) {f} as double) sn, {one('mkt')} sx, {one('ret')} sy, {one('mkt * mkt')} sxx, {one('mkt * ret')} sxy, {one('ret * ret')} syy"


BETA = "case when sn * sxx - sx * sx > 1e-14 then (sn * sxy - sx * sy) / (sn * sxx - sx * sx) else 0 end"


def back(n: int) -> str:
    return f"over (partition by ticker order by t rows {n - 1} preceding)"


#: For each strategy: (further columns from pan, score of those, rebalance, warmup).
SCORES = {
    "momentum": ("*", f"case when t >= 252 then {change(252, 21)} end", 21, 260),
    "trend": ("*", f"case when t >= 252 and {change(252)} > 0 and sigma > 1e-12 then ({change(252)}) / (sigma * sqrt(252)) end", 5, 260),
    "lowvol": ("*", f"case when count(ret) {back(252)} >= 202 and stddev_pop(ret) {back(252)} > 1e-12 then -stddev_pop(ret) {back(252)} end", 21, 260),
    "reversal": (
        f"*, {sums(252)}, count(ret) {back(5)} rn, sum(ret) {back(5)} rs, sum(mkt) {back(5)} ms",
        f"case when rn = 5 and sn >= 201.6 and sigma > 1e-12 and rs - ({BETA}) * ms < 0 then -(rs - ({BETA}) * ms) / (sigma * sqrt(5)) end",
        5,
        260,
    ),
    "resmom": (
        f"*, {sums(231, 21)}",
        f"case when sn >= 120 and (syy - sy * sy / sn) / sn - ({BETA}) * (sxy - sx * sy / sn) / sn > 1e-14 then (sy - ({BETA}) * sx) / sn * sqrt(sn) / sqrt((syy - sy * sy / sn) / sn - ({BETA}) * (sxy - sx * sy / sn) / sn) end",
        21,
        260,
    ),
    "high52": ("*", f"case when t >= 252 and cf > 0 then cf / max(cf) {back(252)} end", 21, 260),
    "lowmax": ("*", f"case when count(ret) {back(21)} >= 10.5 then -max(ret) {back(21)} end", 21, 260),
    "ltrev": ("*", f"-({change(756, 252)})", 21, 760),
}


def scored(name: str, invert: bool = False) -> str:
    cols, score, rebalance, warmup = SCORES[name]
    sign = "-" if invert else ""
    return f"""{universe()}, own as (select {cols} from pan), sc as (select *, {sign}({score}) score from own window w as {BY}),
ranked as (select t, d, ticker, score, row_number() over (partition by t order by score desc, ticker) - 1 rank from sc
  where tradable and score is not null and t >= {warmup} and (t - {warmup}) % {rebalance} = 0)"""


def query(ctes: str, body: str = "") -> str:
    return f"with {ctes}{body}" if body.startswith(",") else f"with {ctes} {body}"
