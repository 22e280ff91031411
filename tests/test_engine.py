"""The engine end to end: an index changes what is read and never the answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skimdex.session import Engine
from skimdex.sources.catalog import IndexExists, NoSuchIndex


def build(spark, path, more=()):
    rows = spark.range(600).select(
        F.when(F.col("id") % 50 != 0, F.col("id").cast("int")).alias("a"),
        F.concat(F.lit("this"), F.col("id") % 40, F.lit(" is")).alias("s"),
        (F.col("id") % 7).cast("int").alias("f"),
        F.when(F.col("id") % 90 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 3).alias("d"),
        F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("t"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"),
        (F.col("id").cast("decimal(12,2)") / 4).cast("decimal(12,2)").alias("m"),
        F.array(F.col("id")).alias("nested"),
    )
    engine = Engine(spark, **{"index.most": 2})
    table = engine.table(path, "t")
    table.write(rows, files=6, sort_by=["a"])
    engine.sql("create sindex ia on t (a)")
    engine.sql("CREATE OINDEX sf ON t (s, f DESC) USING BTREE")
    engine.sql("create oindex bf on t (f) using bitmap")
    for c in more:
        engine.create_index(f"i_{c}", table, [c])
    return table


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Only read from."""
    return build(spark, str(tmp_path_factory.mktemp("engine") / "t"), ("d", "t", "day", "m"))


@pytest.fixture
def table(spark, tmp_path):
    return build(spark, str(tmp_path / "t"))


PREDICATES = [
    "a = 7", "a between 100 and 130", "a > 590 or a is null", "a is null", "a is not null and a < 20", "a in (1, 1, 700, null)", "a = null", "a <=> null",
    "s = 'this7 is' and f > 3", "s like 'this1%'", "s like 'this1%' and s is not null", "startswith(s, 'this3')", "s = 'this2 is' and f in (1, 2)",
    "f = 3", "f = 3 or f is null", "f = 1 or f > 5", "a < 300 and f = 2", "a < 10 or f = 2", "not a = 5", "a % 2 = 0", "f = 2 and a between 30 and 60 and length(s) > 7",
    "d > 190.0", "d = 10", "d < 3", "t < timestamp_ntz '1970-02-01 00:00:00'", "t = '1970-01-05'", "day between '2020-02-01' and '2020-02-10'", "day = date '2020-03-01'",
    "m = 3.25", "m > 140", "a > 3 and a < 2", "a = 12.5", "a < 12.5", "s > 'this38'", "a = '17'", "A = 9 and F = 2",
]


@pytest.mark.parametrize("predicate", PREDICATES)
@pytest.mark.parametrize("fetch", ["files", "rows"])
def test_same_rows_as_a_plain_scan(spark, whole, predicate, fetch):
    plain = spark.read.parquet(whole.path).where(predicate)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole.filter(predicate, fetch=fetch)) == key(plain)


def test_report_and_pruning(whole):
    table = whole
    df, report = table.scan("a between 100 and 110")
    assert report.files == 6 and report.indexes == ["ia"] and len(report.read) == 1 and df.count() == 10
    assert table.scan("a = 5000")[1].read == []
    assert table.scan("length(s) = 3")[1].full == 6


def test_ddl(table):
    engine = table.engine
    with pytest.raises(IndexExists):
        engine.sql("create sindex ia on t (a)")
    engine.sql("create sindex if not exists ia on t (a)")
    with pytest.raises(ValueError):
        engine.sql("create sindex two on t (a, f) using bitmap")
    with pytest.raises(ValueError):
        engine.sql("create sindex none on t (nothing)")
    shown = [tuple(r) for r in engine.sql("show sindex in t").collect()]
    assert ("t", "sf", 1, "f", "D", "BTREE", True) in shown
    engine.sql("disable oindex ia")
    assert "ia" not in table.scan("a = 7")[1].indexes
    engine.sql("enable oindex ia")
    assert table.scan("a = 7")[1].indexes == ["ia"]
    engine.sql("drop sindex ia on t")
    with pytest.raises(NoSuchIndex):
        engine.sql("drop sindex ia on t")
    engine.sql("drop sindex if exists ia on t")
    assert engine.sql("check sindex on t").count() == 0


def test_appended_and_rewritten_files(spark, table):
    extra = spark.read.parquet(table.path).where("a < 5").withColumn("a", F.lit(103))
    extra = spark.createDataFrame(extra.collect(), extra.schema)
    table.write(extra, files=1, mode="append")
    assert table.filter("a = 103").count() == 5
    assert table.engine.sql("check sindex on t").count() == 3
    table.engine.sql("refresh sindex on t")
    assert table.engine.sql("check sindex on t").count() == 0
    assert table.filter("a = 103").count() == 5 and table.scan("a = 3")[1].full == 0
    table.write(extra, files=1, mode="overwrite")
    assert table.filter("a = 103").count() == 4


def test_partitions(spark, tmp_path):
    engine = Engine(spark)
    table = engine.table(str(tmp_path / "p"), "p")
    table.write(spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 3).cast("int").alias("b"), F.concat(F.lit("x "), F.col("id") % 2).alias("c")), files=2, sort_by=["a"], partition_by=["b", "c"])
    engine.sql("create sindex i on p (a) partition (b = 1)")
    assert table.filter("a between 10 and 20").count() == 11
    assert table.filter("a between 10 and 20 and b = 1 and c = 'x 1'").count() == 2
    assert engine.sql("check sindex on p").count() == 0


def test_strategies(spark, whole):
    table = whole
    plain = spark.read.parquet(table.path)
    for up in (True, False):
        want = plain.where("a > 50").orderBy(F.asc("a") if up else F.desc("a")).limit(7).select("a").collect()
        assert table.top_k("a > 50", "a", 7, up, ["a"]).collect() == want
    assert {r.a: r.n for r in table.count_by_key("a < 9", "a").collect()} == dict.fromkeys(range(1, 9), 1)
    left = spark.range(30).select(F.col("id").cast("int").alias("x"))
    assert table.engine.semi_join(left, "x", table, "a < 9", "a").count() == 8
    assert table.engine.semi_join(left, "x", table, "a < 9", "a", "f = 1").count() == 2
    assert table.group_by("a < 9", "a", top=F.max("f")).count() == 8


def test_empty_table_and_no_index(spark, tmp_path):
    table = Engine(spark).table(str(tmp_path / "e"), "e")
    table.write(spark.createDataFrame([], "a int, b string"))
    assert table.filter("a = 1").count() == 0
