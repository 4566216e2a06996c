"""Scalar functions of the engine as column expressions (and, where noted, for numpy)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def exchange_of(ticker: Column) -> Column:
    """What is before the colon; null without one."""
    return F.when(ticker.contains(":"), F.split_part(ticker, F.lit(":"), F.lit(1)))


def code_of(ticker: Column) -> Column:
    return F.element_at(F.split(ticker, ":"), -1)


def safe_name(text: Column) -> Column:
    """A file name: all but ASCII letters, digits, dot and minus become underscores."""
    return F.regexp_replace(text, "[^A-Za-z0-9.-]", "_")


def first_bytes(text: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, n)
    # a byte 10xxxxxx after the cut belongs to the last character, which then goes as a whole
    hexes = F.hex(F.substring(F.encode(text, "UTF-8"), 1, n + 1))
    whole = F.length(F.hex(cut)) == F.length(hexes)
    trimmed = F.regexp_extract(hexes, r"^((?:[0-7].|[C-F].(?:[89AB].)*)*)(?:[0-7].|[C-F].(?:[89AB].)*)$", 1)
    return F.when(whole, text).otherwise(F.decode(F.unhex(trimmed), "UTF-8"))


def previous_weekday(day: Column) -> Column:
    """The last Monday to Friday before a day."""
    return F.date_sub(day, F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1))


def close_utc(day: Column, hour: int, minute: int, zone: str) -> Column:
    """When a market closes, in UTC: a local time of a named zone, daylight saving included."""
    return F.to_utc_timestamp(F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(minute), F.lit(0)), zone)


def thousands(x: Column, places: int = 0) -> Column:
    return F.format_number(x, places)


_A, _B, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of the SplitMix64 generator over unsigned 64-bit numbers (numpy): a hash of a counter."""
    x = np.asarray(x, np.uint64) + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))
