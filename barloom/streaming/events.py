"""Streaming forms of the samplers and intraday rules over an event stream (ts, user_id, event_type, value, event_id)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The events under ``path`` (a folder or one file) as a stream, ts as a timestamp with the session's zone."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    rows = source.option("pathGlobFilter", name).parquet(folder) if one else source.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def ohlc(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count of each event type in tumbling windows; rows later than ``late`` are dropped."""
    seq = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.min_by("value", seq).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", seq).alias("c"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "o", "h", "l", "c", "n")
    )


def last_samples(events: DataFrame, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """The last value of each event type in each sampling interval."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.max_by("value", F.struct("ts", "event_id")).alias("last")).select(F.col("w.start").alias("at"), "event_type", "last")


def deduplicated(events: DataFrame, key: str = "event_id", within: str = "1 day") -> DataFrame:
    """Each key once, as a fill that is reported again counts once."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


class Trailing(StatefulProcessor):
    """A trailing stop for each user: sold when the value falls a share below its highest since the last sale."""

    def __init__(self, share: float) -> None:
        self.share = share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "high double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        high = self.high.get()[0] if self.high.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            if high is not None and r.value <= high * (1 - self.share):
                out.append((key[0], r.event_id, high, r.value))
                high = None
            else:
                high = r.value if high is None else max(high, r.value)
        if high is None:
            self.high.clear()
        else:
            self.high.update((high,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "high", "price"])

    def close(self) -> None:
        pass


def trailing_stops(events: DataFrame, share: float = 0.5) -> DataFrame:
    """(user_id, event_id, high, price) of every sale. Needs the RocksDB state store."""
    rows = events.select("user_id", "event_id", "ts", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(Trailing(share), "user_id long, event_id long, high double, price double", "Append", "None")


class Steps(StatefulProcessor):
    """A state machine a key: ``step`` takes the state (a tuple, or None at first) and a row, and gives the next state and a record or None.

    Rows of a key come by ``ts`` and ``event_id``; a state of None is forgotten.
    """

    def __init__(self, step: Callable, state: str, columns: list[str]) -> None:
        self.step, self.state, self.columns, self.row = step, state, columns, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.now.get()) if self.now.exists() else None
        out = []
        frames = list(rows)
        frame = pd.concat(frames) if len(frames) > 1 else frames[0]
        if self.row is None:  # a class is made once a task, not once a key
            self.row = namedtuple("Row", frame.columns)
        order = np.lexsort((frame["event_id"].to_numpy(), frame["ts"].to_numpy()))
        for r in map(self.row, *(frame[c].to_numpy()[order].tolist() for c in frame.columns)):
            state, record = self.step(state, r)
            if record is not None:
                out += [(*key, *x) for x in record] if isinstance(record, list) else [(*key, *record)]
        if state is None:
            self.now.clear()
        else:
            self.now.update(state)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _steps(rows: DataFrame, by: list[str], step: Callable, state: str, out: str) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]
    return rows.groupBy(*by).transformWithStateInPandas(Steps(step, state, names), out, "Append", "None")


def guard(kind: str, fill: str, stop: float, take: float, breakeven: float) -> Callable:
    """The step of a guarded position: (shares, mean entry, highest price since); ``kind`` is fixed, trail or breakeven.

    Every fill adds a share, and its levels follow from the mean price paid. A fixed stop lies ``stop`` below the entry,
    a trailing one below the highest price; a break-even stop moves to the entry once the price was ``breakeven`` above it.
    """

    def step(state, r):
        n, entry, high = state or (0, 0.0, 0.0)
        if r.event_type == fill:
            return (n + 1, (entry * n + r.value) / (n + 1), max(high, r.value) if n else r.value), None
        if not n:
            return state, None
        line = high * (1 - stop) if kind == "trail" else entry if kind == "breakeven" and high >= entry * (1 + breakeven) else entry * (1 - stop)
        why = "stop" if r.value <= line else "take" if r.value >= entry * (1 + take) else None
        return (None, (r.event_id, why, entry, r.value)) if why else ((n, entry, max(high, r.value)), None)

    return step


def guarded(events: DataFrame, fill: str, stop: float, take: float, breakeven: float) -> DataFrame:
    """(user_id, mode, event_id, why, entry, price) of every sale, for each of the three kinds of stop.

    A user's three positions are one state, so that its rows are sent and sorted once.
    """
    kinds = {k: guard(k, fill, stop, take, breakeven) for k in ("fixed", "trail", "breakeven")}

    def step(state, r):
        now, sales = (), []
        for i, (mode, one) in enumerate(kinds.items()):
            own = state[3 * i : 3 * i + 3] if state else None
            own, record = one(own if own and own[0] else None, r)
            now += own or (0, 0.0, 0.0)
            if record is not None:
                sales.append((mode, *record))
        return now if any(now[::3]) else None, sales or None

    rows = events.select("user_id", "event_id", "ts", "event_type", "value")
    state = ", ".join(f"{k}_n long, {k}_entry double, {k}_high double" for k in kinds)
    return _steps(rows, ["user_id"], step, state, "user_id long, mode string, event_id long, why string, entry double, price double")


def slots_cap(events: DataFrame, slots: int, order: str, fill: str) -> DataFrame:
    """(day, user_id) of the orders that are still open when ``slots`` users have bought on a day: these are cancelled.

    The state of a day holds the users that ordered or bought on it; nothing happens after the day is full.
    """

    def step(state, r):
        opened, bought, full = state or ([], [], False)
        opened, bought = list(opened), list(bought)
        if full:
            return ([], [], True), None
        if r.event_type == order and r.user_id not in opened:
            opened.append(r.user_id)
        elif r.event_type == fill and r.user_id not in bought:
            bought.append(r.user_id)
            if len(bought) >= slots:
                return ([], [], True), [(u,) for u in opened if u not in bought]
        return (opened, bought, False), None

    rows = events.select(F.to_date("ts").alias("day"), "user_id", "event_id", "ts", "event_type").where(F.col("event_type").isin(order, fill))
    return _steps(rows, ["day"], step, "opened array<long>, bought array<long>, full boolean", "day date, user_id long")


def hold(kinds: dict[str, str], stop: float, strength: float, back: float, closes: int) -> Callable:
    """The step of a position over several days: (state, entry, closes so far, stop).

    An order is pending until it is filled, and gone at the first close if it isn't. A held share is sold by its stop,
    at a close ``strength`` above its entry, or at its last close; stopped, it is bought back once the price is ``back``
    above the stop, unless a new order drops it.
    """

    def step(state, r):
        was, entry, done, line = state or ("none", 0.0, 0, 0.0)
        kind, price = kinds.get(r.event_type), r.value
        now, why = was, None
        if was == "none" and kind == "order":
            now, why = "pending", "placed"
        elif was == "pending" and kind in ("fill", "close"):
            now, why = ("held", "filled") if kind == "fill" else ("none", "unfilled")
        elif was == "held" and kind == "price" and price <= line:
            now, why = "stopped", "stop"
        elif was == "held" and kind == "close":
            done += 1
            if done >= closes or price >= entry * (1 + strength):
                now, why = "none", "last close" if done >= closes else "strength"
        elif was == "stopped" and kind == "price" and price >= line * (1 + back):
            now, why = "held", "bought back"
        elif was == "stopped" and kind == "order":
            now, why = "none", "dropped"
        if why in ("filled", "bought back"):
            entry, done, line = price, 0, price * (1 - stop)
        return (now, entry, done, line), (r.event_id, was, now, why, price) if why else None

    return step


def holds(events: DataFrame, kinds: dict[str, str], stop: float, strength: float, back: float, closes: int) -> DataFrame:
    """(user_id, event_id, was, state, why, price) of every change of a user's position; ``kinds`` says what an event type is."""
    rows = events.select("user_id", "event_id", "ts", "event_type", "value")
    out = "user_id long, event_id long, was string, state string, why string, price double"
    return _steps(rows, ["user_id"], hold(kinds, stop, strength, back, closes), "state string, entry double, closes long, stop double", out)


def _shared(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder, on one machine a temporary one, else the warehouse."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            return spark.conf.get("spark.sql.warehouse.dir")
        folder = tempfile.mkdtemp(prefix="barloom-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def drained(stream: DataFrame, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that a stream gives for the input there is, as a table: it runs until the input is used up, then ends.

    Each batch is written by the executors to a shared folder, so that no rows come to the driver; in mode ``complete``
    it replaces the one before. The state goes when the stream ends, the rows when the driver does.
    """
    spark = stream.sparkSession
    folder = f"{_shared(spark)}/drained-{uuid.uuid4().hex}"
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path("rows").getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path("rows"))
    files.deleteOnExit(path("."))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'all' if mode == 'complete' else number}")

    try:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        files.delete(path("state"), True)
    out = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    return then(out) if then else out


def upserted(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("start", "event_type")) -> None:
    """Runs a stream of changed rows into a Parquet table, one version a batch; a batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/version={number:010d}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("start", "event_type")) -> DataFrame:
    """The newest version of each row that ``upserted`` wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")
