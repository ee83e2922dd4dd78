"""Small files are dealt to all tasks before Python works on their rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans import adapters as A
from quillspark.plans import catalog


@pytest.mark.parametrize("name, rows", [("note_chunks", 25), ("rule_literals", 3600), ("varied_headers", 10)])
def test_python_work_is_spread(spark, sf, name, rows):
    out = catalog.queries()[name](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert out.count() >= rows


def test_spread_uses_every_task(spark, sf):
    held = A.spread(A.table(spark, sf, "part"), "p_partkey").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 4 and sum(r["count"] for r in held) == 200
