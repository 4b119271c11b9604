"""Running totals over stored ranges."""

from pyspark.sql import functions as F

from corpusforge.operators.indexing import dense_index, running_total
from corpusforge.sources.shared import owning


def test_no_row_carries_the_borders(spark):
    """A row costs the same however many ranges there are; totals are those of one range."""
    rows = spark.range(3000).select(F.struct((F.col("id") * 7919 % 3000).alias("a"), F.lit("x").alias("b")).alias("k"), (F.col("id") % 5).alias("w"), F.lit(1).alias("_place"))
    with owning(spark):
        got = dense_index(rows, "k", range_rows=100)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "_borders" not in plan
        assert got.where("index <> k.a").count() == 0 and got.count() == 3000 and got.columns == ["k", "w", "_place", "index"]
        many, one = (running_total(rows, "k", "w", range_rows=n).orderBy("k").select("total").collect() for n in (100, 10**6))
        assert many == one
