"""Queries whose plain text would put a whole table or group into one task."""

from pyspark.sql import functions as F

from skimdex.plans import relational


def test_windows_over_a_whole_table_are_dealt_out(spark, tmp_path):
    """Duplicate, null and negative keys; no stage may end in one window over all rows."""
    keys = [None, None, *range(-30, 30), 7, 7, 4085, *range(4090, 4100), 8191, 8192, 1 << 40]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("win_ntile", "win_range_frame"):
        got = relational.queries()[name](spark, str(tmp_path))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        spark.read.parquet(str(tmp_path / "orders.parquet")).createOrReplaceTempView("orders")
        want = spark.sql(relational.SAME[name])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
        assert "ntile(" not in plan and "windowspecdefinition(o_orderkey" not in plan


def test_an_aggregate_in_python_never_gets_a_whole_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relational, "STRETCH", 10)
    rows = spark.range(0, 100, 1, 1).select(F.when(F.col("id") < 90, F.lit("A")).otherwise("B").alias("l_returnflag"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("l_quantity"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = relational.queries()["udf_aggregate"](spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [l_returnflag") == 2
    assert {r.l_returnflag: r.spread for r in got.collect()} == {"A": 88.0, "B": 7.0}
