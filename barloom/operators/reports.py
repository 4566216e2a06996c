"""Reports, logs and their folds: JSON fields by alias, order books, results against fills, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def field(json: Column, *names: str) -> Column:
    """The first of several field names that a JSON object has, whatever the case of its letters."""
    low = F.lower(json)
    return F.coalesce(*(F.get_json_object(low, f"$.{n.lower()}") for n in names))


def fold_log(log: DataFrame) -> DataFrame:
    """(day, market, placed, result): of each kind the last record a day and market; ``log`` has day, market, kind, x, at."""
    pick = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("x")), F.when(F.col("kind") == k, F.col("at"))).alias(k)
    return log.groupBy("day", "market").agg(pick("placed"), pick("result"))


def changed_books(books: DataFrame) -> DataFrame:
    """(market, day, changed): whether a day's multiset of orders (ticker, limit to 6 places) differs from the day before."""
    own = books.groupBy("market", "day").agg(F.sort_array(F.collect_list(F.struct("ticker", F.round("lim", 6).alias("lim")))).alias("book"))
    before = F.lag("book").over(Window.partitionBy("market").orderBy("day"))
    return own.select("market", "day", F.coalesce(F.col("book") != before, F.lit(True)).alias("changed"))


def against_fills(model: DataFrame, fills: DataFrame) -> DataFrame:
    """Model results (day, market, symbol, ret) with the broker's (fill): both, model only, or broker only."""
    both = model.join(fills, ["day", "market", "symbol"], "full")
    kind = F.when(F.col("ret").isNull(), "broker").when(F.col("fill").isNull(), "model").otherwise("both")
    return both.withColumn("kind", kind)


def match_summary(matched: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return matched.groupBy("market").agg(n("both"), n("model"), n("broker"), F.avg(F.when(F.col("kind") == "both", F.col("fill") - F.col("ret"))).alias("gap"))


def symbol_trades(fills: DataFrame) -> DataFrame:
    """Of each symbol's fills (side, qty, price, fee, at): quantities, average prices, profit and the last sale."""
    buy, sell = F.col("side") == "B", F.col("side") == "S"
    total = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    bought, sold = total(buy, F.col("qty")), total(sell, F.col("qty"))
    paid, got = total(buy, F.col("qty") * F.col("price")), total(sell, F.col("qty") * F.col("price"))
    vb, vs = F.try_divide(paid, bought), F.try_divide(got, sold)
    return fills.groupBy("symbol").agg(
        bought.alias("bought"), sold.alias("sold"), vb.alias("buy_price"), vs.alias("sell_price"), (F.least(bought, sold) * (vs - vb) - F.sum("fee")).alias("pnl"), F.sum("fee").alias("fee"), F.max(F.when(sell, F.col("at"))).alias("sold_at")
    )


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each ticker."""
    order = Window.partitionBy("ticker").orderBy(F.desc("d"))
    return bars.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def tickers_of(pages: DataFrame, pattern: str = r'href="/([A-Za-z]{2,6})"') -> DataFrame:
    """Distinct codes that the pages link to, with the number of pages."""
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("code"))
    return found.groupBy("code").agg(F.count("*").alias("pages"))


def report_json(orders: DataFrame) -> DataFrame:
    """(t, report): the day's orders as one nested JSON document, in the order of their place."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", "ticker", "gross", "cost"))), lambda x: x)
    return orders.groupBy("t").agg(F.to_json(F.struct(F.count("*").alias("n"), rows.alias("orders"))).alias("report"))


def report_text(orders: DataFrame) -> DataFrame:
    """(t, report): the day's orders as lines of plain text, in the order of their place, under a line with their number."""
    line = F.format_string("%d. %s, expected %.2f%%, costs %.2f%%", F.col("place") + 1, F.col("ticker"), 100 * F.col("gross"), 100 * F.col("cost"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return orders.groupBy("t").agg(F.concat_ws("\n", F.concat(F.count("*").cast("string"), F.lit(" orders")), F.array_join(lines, "\n")).alias("report"))


def book_json(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """(t, book): ``report_json`` with the day's updates of what is held (t, ticker, keep), by ticker."""
    moves = F.sort_array(F.collect_list(F.struct("ticker", "keep")))
    rows = F.sort_array(F.collect_list(F.struct("place", "ticker", "gross", "cost")))
    own = orders.groupBy("t").agg(rows.alias("orders")).join(updates.groupBy("t").agg(moves.alias("updates")), "t", "left")
    return own.select("t", F.to_json(F.struct("orders", F.coalesce("updates", F.array().cast("array<struct<ticker:string,keep:boolean>>")).alias("updates"))).alias("book"))


def unit_ratio(paid: Column, modelled: Column) -> Column:
    """paid / modelled after the unit (1, 1/100 or 100) that brings it nearest to one is taken out; ties to the first."""
    r = paid / modelled
    off = lambda s: F.abs(F.log(r / s))
    return r / F.when((off(1.0) <= off(0.01)) & (off(1.0) <= off(100.0)), 1.0).when(off(0.01) <= off(100.0), 0.01).otherwise(100.0)


def broker_history(rows: DataFrame, *by: str) -> DataFrame:
    """Of orders with what was traded and what the model says, by ``by``: rates, wins, profit, agreement, gap and returns.

    ``rows`` has filled, ret, pnl, paid (the broker's; null where nothing is known) and model_filled, model_ret, entry.
    A share counts as bought where ``filled``; the gap of entries is after ``unit_ratio``.
    """
    both = F.col("filled") & F.col("model_filled")
    checked = F.col("model_filled").isNotNull()
    gap = F.when(both, unit_ratio(F.col("paid"), F.col("entry")) - 1)
    known = both & F.col("ret").isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("orders"),
        F.count_if("filled").alias("bought"),
        F.count_if(F.col("filled") & (F.col("ret") > 0)).alias("wins"),
        F.sum(F.when(F.col("filled"), F.col("pnl")).otherwise(0.0)).alias("pnl"),
        F.count_if(checked).alias("checked"),
        F.count_if(checked & (F.col("filled") == F.col("model_filled"))).alias("agree"),
        F.avg(gap).alias("gap"),
        F.avg(F.when(known, F.col("ret"))).alias("ret"),
        F.avg(F.when(known, F.col("model_ret"))).alias("model_ret"),
    )


def fill_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(field, filled): how many rows have a value other than null, empty text and the number zero, in one pass."""

    def filled(c: str) -> Column:
        kind = rows.select(c).schema[0].dataType
        none = F.lit("") if isinstance(kind, StringType) else F.lit(0) if isinstance(kind, NumericType) else None
        return F.col(c).isNotNull() if none is None else F.col(c) != none

    some = [F.struct(F.lit(c).alias("field"), F.count_if(filled(c)).alias("filled")) for c in columns]
    return rows.agg(F.array(*some).alias("x")).select(F.inline("x"))


def append_once(track: DataFrame, new: DataFrame) -> DataFrame:
    """``track`` with the days of ``new`` that it hasn't got."""
    return track.unionByName(new.join(track.select("d"), "d", "left_anti"))


def order_results(orders: DataFrame) -> DataFrame:
    """(daily, annual, orders, fill): of orders (day, ret, filled) the mean day, that compounded over a year, orders a day, share filled."""
    one = F.when(F.col("filled"), F.col("ret")).otherwise(0.0)
    days = orders.groupBy("day").agg(F.avg(one).alias("m"), F.count("*").alias("n"), F.count_if("filled").alias("f"))
    return days.agg(F.avg("m").alias("daily"), (F.pow(1 + F.avg("m"), F.lit(252.0)) - 1).alias("annual"), F.avg("n").alias("orders"), (F.sum("f") / F.sum("n")).alias("fill"))


def totals(positions: DataFrame) -> DataFrame:
    """(currency, total, bought, held, waiting): profit of what was bought or is held, and how many are in each state."""
    own = F.col("state").isin("bought", "held")
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return positions.groupBy("currency").agg(F.sum(F.when(own, F.coalesce("pnl", F.lit(0.0)) + F.coalesce("open", F.lit(0.0))).otherwise(0.0)).alias("total"), n("bought"), n("held"), n("waiting"))


def expected_buys(orders: DataFrame) -> DataFrame:
    """(buys, hold): the sum of the orders' chances to fill, and their mean holding time."""
    return orders.agg(F.sum(F.coalesce("fill", F.lit(0.0))).alias("buys"), F.avg("hold").alias("hold"))


def stop_levels(positions: DataFrame, settings_stop: float = 0.0, vol: float = 0.0) -> DataFrame:
    """``positions`` (ticker, close, sigma, level) with the stop of the next session: a held one's own level, else from the close."""
    band = F.least(F.lit(0.5), F.greatest(F.lit(0.02), vol * F.coalesce("sigma", F.lit(0.02))))
    fresh = F.col("close") * (1 - band) if vol else F.when(F.lit(settings_stop) > 0, F.col("close") * (1 - settings_stop))
    return positions.withColumn("stop", F.coalesce("level", fresh))
