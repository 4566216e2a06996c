"""Costs of orders and order lists, in the currency of the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markets' price unit, least price, least traded value and number of most traded shares.
MARKETS = (
    ("UK", 100.0, 20.0, 250_000.0, 300),
    ("EU", 1.0, 1.0, 250_000.0, 500),
    ("US", 1.0, 1.0, 1_000_000.0, 1000),
    ("APAC", 1.0, 0.1, 250_000.0, 400),
    ("INDEX", 1.0, 0.0, 0.0, 0),
    ("FOREX", 1.0, 0.0, 0.0, 0),
)


def commission(market: Column, value: Column, shares: Column, rate: Column | None = None, least: Column | None = None, tiered: bool = False) -> Column:
    """Commission of an order, at fixed or tiered prices; ``rate`` and ``least`` of a venue, where it has them."""
    other = F.greatest(F.coalesce(least, F.lit(3.0)) if least is not None else F.lit(3.0), (F.coalesce(rate, F.lit(0.0005)) if rate is not None else F.lit(0.0005)) * value)
    above = lambda least, x: F.greatest(F.lit(least), x)
    us = above(0.35, 0.0035 * shares) + 0.0005 * shares if tiered else F.least(0.01 * value, above(1.0, 0.005 * shares))
    uk = above(1.0, 0.0005 * value) + above(0.10, 0.000045 * value) + 0.06 if tiered else above(3.0, 0.0005 * value)
    return F.when(market == "FOREX", above(2.0, 2e-5 * value)).when(market == "US", us).when(market == "UK", uk).otherwise(other)


def scaled_venues(venues: DataFrame, capital: float, base: float) -> DataFrame:
    """``venues`` with their amounts scaled as the capital is to the one they were made for; without a base they stay."""
    return venues.withColumn("amount", F.col("amount") * capital / base) if base > 0 else venues


def buy_tax(market: Column, free: Column, venue_tax: Column | None = None) -> Column:
    """Tax on a purchase, as a share of its value."""
    return F.when(market.isin("US", "FOREX"), 0.0).when((market == "UK") & ~free, 0.005).when(market == "UK", 0.0).otherwise(F.coalesce(venue_tax, F.lit(0.0)) if venue_tax is not None else F.lit(0.0))


def sale_fee(market: Column, value: Column, shares: Column) -> Column:
    return F.when(market == "US", 2.78e-5 * value + F.least(F.lit(8.30), 1.66e-4 * shares)).otherwise(0.0)


def round_trip(market: Column, value: Column, shares: Column, free: Column) -> Column:
    """Costs of a purchase and its sale, as a share of the value."""
    return (2 * commission(market, value, shares) + sale_fee(market, value, shares)) / value + buy_tax(market, free)


def amount(capital: float, value: Column, share: float = 0.01) -> Column:
    """Money of an order: the capital, but not over a share of the day's traded value."""
    return F.least(F.lit(float(capital)), share * value)


def cap(sigma: Column, capsd: float = 1.5, capmax: float = 0.03) -> Column:
    """How far over the close a buy may pay."""
    return F.least(F.lit(capmax), capsd * F.coalesce(sigma, F.lit(0.02)))


def net_orders(orders: DataFrame) -> DataFrame:
    """Orders that earn more than they cost (gross, cost); targets before reserves, then by gross and rank."""
    return orders.where("gross - cost > 0").orderBy("reserve", F.desc("gross"), "rank")


def to_tick(price: Column, tick: Column) -> Column:
    return F.floor(price / tick + 1e-9) * tick
