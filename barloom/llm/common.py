"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python: whole texts, so a batch stays within tens of MB.
ARROW_ROWS = 1000
#: Share of the largest heap of the driver above which a cut of lineage has its garbage collected.
HEAP_SHARE = 0.4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of whole texts small, unless the session has set a size below that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def work_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder is set on one machine (``local[...]``); on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="barloom-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def collect_garbage(spark: SparkSession) -> None:
    """Have the driver collect its garbage where its heap has grown over ``HEAP_SHARE`` of the largest.

    Only then does Spark drop the broadcasts, shuffles and checkpoints that no plan needs any more. Left alone, the heap
    rather grows over many short jobs, up to the largest, however little is alive in it; a full collection shrinks it again.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` kept in the checkpoint folder of the session; the shuffle files of the steps before it go as soon as it is written."""
    spark = df.sparkSession
    work_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before or "false")
    collect_garbage(spark)
    return kept


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that further columns can't clash with them."""
    return df.select(*(F.col(f"`{v}`").alias(k) for k, v in wanted.items()))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
