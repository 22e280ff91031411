"""Capabilities, scan metrics, cached data, two writers of a catalog, and the console sink."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from skimdex.operators.choose import Able, satisfies
from skimdex.session import Engine
from skimdex.sources.catalog import Catalog, IndexMeta


def made(spark, path):
    engine = Engine(spark)
    table = engine.table(path, "t")
    table.write(spark.range(400).select(F.col("id").cast("int").alias("a"), (F.col("id") % 5).cast("int").alias("f")), files=4, sort_by=["a"])
    engine.sql("create sindex ia on t (a)")
    engine.sql("create sindex bf on t (f) using bitmap")
    return table


def test_capabilities():
    assert satisfies("btree", Able.ORDER | Able.ITERATE | Able.EXISTENCE)
    assert satisfies("bitmap", Able.EXISTENCE) and not satisfies("bitmap", Able.EXISTENCE | Able.ORDER) and not satisfies("bitmap", Able.ITERATE)


def test_counts_and_existence_from_a_bitmap(spark, tmp_path):
    table = made(spark, str(tmp_path / "t"))
    assert {r.f: r.n for r in table.count_by_key("f in (1, 3)", "f").collect()} == {1: 80, 3: 80}
    assert sorted(r.x for r in table.engine.semi_join(spark.range(9).withColumnRenamed("id", "x"), "x", table, "f in (1, 3)", "f").collect()) == [1, 3]
    assert [r.f for r in table.top_k("f in (1, 3)", "f", 2).collect()] == [1, 1]


def test_metrics(spark, tmp_path):
    table = made(spark, str(tmp_path / "t"))
    assert table.engine.metrics().collect() == []
    table.filter("a between 10 and 20")
    table.filter("length(cast(a as string)) = 2")
    table.engine.sql("select count(*) from t where a > 395")
    first, second, third = table.engine.metrics().collect()
    assert (first.table, first.indexes, first.files, first.skipped, first.rows_known, first.bytes_skipped > 0) == ("t", ["ia"], 4, 3, 400, True)
    assert 0 < first.rows_skipped < 400 and (second.full, second.rows_skipped, second.bytes_skipped) == (4, 0, 0)
    assert third.skipped == 3


def test_cached_scans_are_shown(spark, tmp_path):
    table = made(spark, str(tmp_path / "t"))
    df = table.filter("a < 50", cache=True)
    assert df.count() == 50
    assert any(r.cached_partitions > 0 and r.memory_bytes + r.disk_bytes > 0 for r in table.engine.cached().collect())
    df.unpersist()


def test_two_writers_lose_nothing(spark, tmp_path):
    table = made(spark, str(tmp_path / "t"))
    stale = Catalog(spark, table.path)
    number = max(stale._numbers())
    assert not stale.store.create_json(f"{stale.root}/catalog-{number}.json", {"indexes": []})
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Catalog(spark, table.path).put(IndexMeta(f"x{i}", "btree", ["a"], [True])), range(12)))
    assert {x.name for x in table.catalog.indexes()} == {"ia", "bf", *(f"x{i}" for i in range(12))}
    assert not [n for n in stale.store.names(stale.root) if n.endswith(".tmp")]


def test_console_sink(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("console").option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == 3
