"""Sources of daily bars: trades, CSV files, lists, venue tables, symbol stores, a generated market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = "d date, ticker string, o double, h double, l double, c double, v double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """Trades made of line items: ticker, d, price, qty and a total order. Only the columns needed are read."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(key).alias("ticker"))
    price = F.lit(100) * (1 + F.col("l_tax") - F.col("l_discount")) + F.lit(0.01) * F.col("l_quantity")
    joined = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        "ticker",
        F.to_date("l_shipdate").alias("d"),
        price.alias("price"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("price"), "l_quantity").alias("seq"),
    )


def to_bars(ticks: DataFrame) -> DataFrame:
    """Open, high, low, close and volume of each ticker and day, with partial aggregation before the shuffle."""
    return ticks.groupBy("ticker", "d").agg(
        F.min_by("price", "seq").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "seq").alias("c"), F.sum("qty").alias("v")
    )


def bars(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    return to_bars(trades(spark, sf_dir, key))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files whose header names the columns in any order; a field that isn't a number counts as 0.

    Rows that aren't valid bars are dropped; of rows for one day and ticker the last one in the file counts.
    """
    raw = spark.read.option("header", True).csv(path)
    named = {c.strip().lower(): c for c in raw.columns}
    number = lambda c: F.coalesce(F.expr(f"try_cast(`{named[c]}` as double)"), F.lit(0.0))
    rows = raw.select(
        F.expr(f"try_cast(substring(`{named['date']}`, 1, 10) as date)").alias("d"),
        F.col(f"`{named['ticker']}`").alias("ticker"),
        number("open").alias("o"),
        number("high").alias("h"),
        number("low").alias("l"),
        number("close").alias("c"),
        number("volume").alias("v"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )
    return last_wins(valid(rows.where("d is not null")), "at")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("o > 0 and h > 0 and l > 0 and c > 0 and h >= l")


def last_wins(rows: DataFrame, order: str) -> DataFrame:
    """One row a day and ticker, the last by ``order``."""
    rest = [c for c in rows.columns if c not in ("d", "ticker", order)]
    return rows.groupBy("d", "ticker").agg(F.max_by(F.struct(*rest), order).alias("r")).select("d", "ticker", "r.*")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """First word of each line; empty lines and comments are left out."""
    first = F.regexp_extract("value", r"^\s*([^#\s]\S*)", 1)
    return spark.read.text(path).select(first.alias("ticker")).where("ticker != ''").distinct()


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    """Exchange and its cost numbers; the seventh number is the fifth where it is missing."""
    w = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    names = ("amount", "rate", "least", "fee", "buy_tax", "both_tax", "held_tax")
    number = lambda i: F.expr(f"try_cast(get(w, {i}) as double)")
    rows = spark.read.text(path).select(w.alias("w")).where("w[0] != ''")
    cols = [number(i + 1).alias(n) for i, n in enumerate(names[:6])]
    return rows.select(F.col("w")[0].alias("exchange"), *cols, F.coalesce(number(7), number(5)).alias("held_tax"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Bars of JSON files that map days to values, one file a symbol; missing open, high and low are the close."""
    day = "map<string,struct<o:double,h:double,l:double,c:double,v:double>>"
    name = F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"/ticker=([^/]+)/[^/]*$", 1), F.lit("")), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.url_decode(name).alias("ticker"), F.from_json("value", day).alias("m"))
    rows = text.select("ticker", F.explode("m").alias("day", "b"))
    filled = [F.coalesce(f"b.{x}", "b.c").alias(x) for x in "ohl"]
    return rows.select(F.expr("try_cast(day as date)").alias("d"), "ticker", *filled, "b.c", F.coalesce("b.v", F.lit(0.0)).alias("v")).where("d is not null and c > 0")


def save_store(bars: DataFrame, path: str) -> None:
    """Writes bars as the store has them: a JSON file a symbol that maps days to values, one file a task's group.

    A symbol's days are one value here as they are one file there; symbols are spread over the cluster.
    """
    day = F.struct(F.date_format("d", "yyyy-MM-dd").alias("key"), F.struct("o", "h", "l", "c", "v").alias("value"))
    text = bars.groupBy("ticker").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(day)))).alias("value"))
    text.write.mode("overwrite").partitionBy("ticker").text(path)


def newest(spark: SparkSession, folder: str, keep: int | None = None) -> list[str]:
    """Files of a folder by name, the newest (largest) first; with ``keep`` those after the first so many are deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((x.getPath().getName() for x in files.listStatus(path) if x.isFile()), reverse=True) if files.exists(path) else []
    for name in names[keep:] if keep is not None else []:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), False)
    return names[:keep]


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` replaces rows of the same day and ticker; an empty ``new`` changes nothing."""
    return old.join(new.select("d", "ticker").distinct(), ["d", "ticker"], "left_anti").unionByName(new)


def synthetic(spark: SparkSession, tickers: int = 80, sessions: int = 1400, seed: int = 7) -> DataFrame:
    """A generated market: drifts redrawn every 63 sessions, a common shock, 2 % of bars missing. Equal for any partitioning."""

    def normal(*key) -> F.Column:
        unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key), F.lit(1_000_003)) + 0.5) / 1_000_003
        return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))

    grid = spark.range(sessions).withColumnRenamed("id", "t").crossJoin(F.broadcast(spark.range(tickers).withColumnRenamed("id", "i")))
    mu = 0.0008 * normal(F.col("i"), F.floor(F.col("t") / 63), F.lit("drift"))
    step = mu + 0.008 * normal(F.col("t"), F.lit("market")) + 0.015 * normal(F.col("i"), F.col("t"), F.lit("own"))
    gap = 0.004 * normal(F.col("i"), F.col("t"), F.lit("gap"))
    own = Window.partitionBy("i").orderBy("t")
    path = grid.select("t", "i", step.alias("step"), gap.alias("gap")).withColumn("lc", F.sum(F.col("step") + F.col("gap")).over(own))
    c = 100 * F.exp("lc")
    o = 100 * F.exp(F.col("lc") - F.col("step"))
    day = F.make_date((F.lit(2019) + F.floor(F.col("t") / 252)).cast("int"), (1 + F.floor(F.col("t") % 252 / 21)).cast("int"), (1 + F.col("t") % 21).cast("int"))
    kept = path.where(F.pmod(F.xxhash64(F.lit(seed), "i", "t", F.lit("missing")), F.lit(50)) != 0)
    volume = (20_000 + F.pmod(F.xxhash64(F.lit(seed), "i", "t", F.lit("volume")), F.lit(80_001))).cast("double")
    return kept.select(
        day.alias("d"), F.format_string("S%02d", "i").alias("ticker"), o.alias("o"), (F.greatest(o, c) * 1.005).alias("h"), (F.least(o, c) * 0.995).alias("l"), c.alias("c"), volume.alias("v")
    )
