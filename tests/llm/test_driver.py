"""What the operators ask of the driver's memory."""

from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm.graph import _large_star, _small_star, joined_apart


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_small_groups_are_not_sent_to_the_driver(spark):
    many = spark.createDataFrame([(k % 7, k) for k in range(100)], "u long, v long")
    found = joined_apart(many, many.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")), "u", "of")
    assert sorted(map(tuple, found.collect())) == sorted((k % 7, k, k % 7) for k in range(100))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rounds_make_their_rows_once_and_broadcast_nothing(spark):
    edges = C.cut_lineage(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 3)], "u long, v long"))
    found = _small_star(_large_star(edges))
    assert {tuple(r) for r in found.where("u != v").collect()} >= {(5, 3), (4, 3), (8, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Union" not in plan


def test_a_grown_heap_is_collected_at_a_cut(spark, monkeypatch):
    monkeypatch.setattr(C, "HEAP_SHARE", 0.0)
    before = collections(spark)
    assert C.cut_lineage(spark.range(3)).count() == 3
    assert collections(spark) > before
    monkeypatch.setattr(C, "HEAP_SHARE", 1.0)
    before = collections(spark)
    C.collect_garbage(spark)
    assert collections(spark) == before
