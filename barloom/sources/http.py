"""Lists behind HTTP as a data source, tried again while a server is busy, and kept a day."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses after which a request is made again, besides 500 and above; 0 is no answer.
BUSY = (0, 429)


def fetch(url: str, tries: int = 5, wait: float = 1.0, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """(status, body) of a request; while the server is busy it is made again, after a time that doubles."""
    status, body = 0, ""
    for attempt in range(tries):
        if attempt:
            sleep(wait * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            status, body = e.code, e.read().decode("utf-8", "replace")
        except OSError:
            status, body = 0, ""
        if status not in BUSY and status < 500:
            break
    return status, body


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.tries, self.wait = int(options.get("tries", 5)), float(options.get("wait", 1.0))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value, *fetch(partition.value, self.tries, self.wait))


class HttpLists(DataSource):
    """``spark.read.format("barloom_http").option("urls", ...)``: a row a URL (url, status, body), each a partition."""

    @classmethod
    def name(cls) -> str:
        return "barloom_http"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def lists(spark: SparkSession, urls: Sequence[str], tries: int = 5, wait: float = 1.0) -> DataFrame:
    spark.dataSource.register(HttpLists)
    return spark.read.format("barloom_http").option("urls", "\n".join(urls)).option("tries", tries).option("wait", wait).load()


def cached(spark: SparkSession, url: str, folder: str, day: str, offline: bool = False, **how) -> DataFrame:
    """The list of a day, one file a day under ``folder``; fetched where the day has none, or with ``offline`` the newest there is.

    A request that fails leaves no file; the newest older list serves, and none at all is an error.
    """
    have = newest_days(spark, folder)
    if not offline and day not in have:
        got = lists(spark, [url], **how).where("status = 200")
        if not got.isEmpty():
            got.select("body").write.mode("overwrite").text(f"{folder}/day={day}")
            have = [day, *have]
    best = next((d for d in sorted(have, reverse=True) if d <= day), None)
    if best is None:
        raise FileNotFoundError(f"no list for {day} or before under {folder}")
    return spark.read.option("wholetext", True).text(f"{folder}/day={best}")


def newest_days(spark: SparkSession, folder: str) -> list[str]:
    """Days that ``cached`` has kept, the newest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = (x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else ()
    return sorted((n.removeprefix("day=") for n in names if n.startswith("day=")), reverse=True)
