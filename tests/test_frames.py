"""Frames of one call share two sorts, and a task's rows don't grow with the table."""

from pyspark.sql import functions as F

from quillspark.operators import frames
from quillspark.plans import catalog


def test_frames_of_a_query_sort_twice_and_shuffle_once(spark, sf):
    for name in ("frame_groups", "frame_exclude", "frame_rows_exclude"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sum(" Sort [" in x for x in plan) == 2 and sum("Exchange hashpartitioning" in x for x in plan) == 1, name


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    spark.range(60_000).select((F.col("id") % 997).alias("k"), "id").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(frames, "TASK_BYTES", 1 << 13)
    near = frames.Frame(("k",), ("id",), "rows", -1, 0)
    out = frames.over(rows, near, n=("count", None))
    held = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(held) == 60_000 and max(held) < 6_000
    assert out.agg(F.sum("n")).first()[0] == 2 * 60_000 - 997
