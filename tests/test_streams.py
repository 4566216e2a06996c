"""Streams drained to shared files, tables that are folders, counts of filled fields."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import reports
from barloom.plans import stream_queries
from barloom.streaming import events


@pytest.fixture
def folder(spark, tmp_path):
    """Events of ten days as a folder of three files, none in order of time, each event reported in one file only."""
    n = 300
    rows = pd.DataFrame({"event_id": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="48min"), "user_id": [i % 7 for i in range(n)], "event_type": ["purchase", "view", "click"] * (n // 3), "value": [float(50 + 37 * i % 101) for i in range(n)]})
    for part in (rows[200:], rows[:100], rows[100:200]):
        spark.createDataFrame(part[::-1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return rows, str(tmp_path)


def test_deduplicated_rows_stay_with_the_executors(spark, folder):
    rows, path = folder
    once = events.drained(events.deduplicated(events.read(spark, f"{path}/events.parquet", files=100).select("event_id", "user_id", "ts")))
    assert sorted(r.event_id for r in once.collect()) == list(range(300))
    assert once.inputFiles() and not any("/state/" in x for x in once.inputFiles())  # files, not rows that the driver holds


def test_dedupe_of_a_folder_counts_every_file(spark, folder):
    rows, path = folder
    got = {r.user_id: r.n for r in stream_queries.stream_dedupe(spark, path).collect()}
    assert got == rows.groupby("user_id")["event_id"].nunique().to_dict()


def test_complete_output_is_that_of_the_last_batch(spark, folder):
    rows, path = folder
    got = events.drained(events.ohlc(events.read(spark, f"{path}/events.parquet"), "1 day"), "complete").toPandas()  # a batch a file
    assert got["n"].sum() == len(rows) and not got.duplicated(["start", "event_type"]).any()


def test_a_stream_without_rows_gives_an_empty_table(spark, folder):
    rows, path = folder
    out = events.drained(events.read(spark, f"{path}/events.parquet").where("event_id < 0").select("event_id"))
    assert out.columns == ["event_id"] and out.count() == 0


def test_filled_fields_by_their_type(spark):
    rows = spark.createDataFrame([(0.0, "0", 0), (-0.0, "0.0", 1), (0.001, "", None), (None, None, 2), (-5.0, "x", 0)], "d double, s string, n int")
    rows = rows.withColumn("m", F.expr("cast(n as decimal(9, 2))"))
    assert {r.field: r.filled for r in reports.fill_counts(rows, "d", "s", "n", "m").collect()} == {"d": 2, "s": 3, "n": 2, "m": 2}


def test_guarded_positions_go_on_in_the_next_batch_and_stay_with_the_executors(spark, folder, tmp_path):
    rows, path = folder
    rows = rows.assign(ts=rows["ts"].dt.floor("4h"))  # equal times: the event_id decides
    for i in range(3):
        spark.createDataFrame(rows[100 * i : 100 * i + 100][::-1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "ties"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        by_file, at_once = (events.drained(events.guarded(events.read(spark, str(tmp_path / "ties"), files=n), "purchase", 0.4, 0.2, 0.25)) for n in (1, 100))
    finally:
        spark.conf.unset(key)
    assert at_once.inputFiles()
    got, want = sorted(map(tuple, at_once.collect())), []
    for mode in ("fixed", "trail", "breakeven"):
        step, states = events.guard(mode, "purchase", 0.4, 0.2, 0.25), {}
        for r in rows.itertuples():
            states[r.user_id], sale = step(states.get(r.user_id), r)
            want += [(r.user_id, mode, *sale)] if sale else []
    assert got == sorted(want) == sorted(map(tuple, by_file.collect())) and len({x[1] for x in want}) == 3
