"""Statistics of large files: exact, and in short rows that no task has to hold together."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skimdex.operators import build
from skimdex.operators.metadata import gathered, may_hold, read_rows, table_of
from skimdex.session import Engine

KEYS = 30_000


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two files of many keys each, some of them null, none in order."""
    engine = Engine(spark)
    table = engine.table(str(tmp_path_factory.mktemp("statistics") / "t"), "t")
    rows = spark.range(KEYS * 2).select(F.when(F.col("id") % 100 > 0, F.col("id") * 7919 % KEYS).alias("a"), F.concat(F.lit("s"), F.col("id") % 3).alias("s"))
    table.write(rows, files=2)
    engine.sql("create sindex ia on t (a, s)")
    return table


def test_no_row_grows_with_the_keys_of_a_file(spark, table):
    path, store = f"{table.catalog.root}/ia/{table.catalog.index('ia').versions[0]}", table.catalog.store
    assert store.size(f"{path}/files") < 20_000
    bits = spark.read.parquet(f"{path}/bloom").agg(F.max(F.length("bits")).alias("most"), F.count("*").alias("n")).first()
    assert bits.n >= 2 * 32 and bits.most <= 4096


def test_parts_and_sample_are_those_of_all_keys(spark, table):
    index = table.catalog.index("ia")
    entries = table_of(spark, table.catalog, index, "entries").where("k0 is not null")
    by_key, by_hash = Window.partitionBy("file").orderBy("k0", "k1"), Window.partitionBy("file").orderBy(F.xxhash64("k0", "k1"))
    ranked = entries.select("file", "k0", "k1", F.ntile(5).over(by_key).alias("part"), F.sum("n").over(by_key).alias("upto"), F.row_number().over(by_hash).alias("at"), F.count("*").over(Window.partitionBy("file")).alias("keys"))
    key = F.struct("k0", "k1")
    want = {(r.file, r.part): (tuple(r.low), tuple(r.high), r.upto) for r in ranked.groupBy("file", "part").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max("upto").alias("upto")).collect()}
    files = table_of(spark, table.catalog, index, "files").collect()
    assert {(r.file, p.part): (tuple(p.low), tuple(p.high), p.upto) for r in files for p in r.parts} == want and len(want) == 10
    assert sum(r.rows for r in files) == KEYS * 2 and sum(r.nulls for r in files) == KEYS * 2 // 100
    sample = table_of(spark, table.catalog, index, "sample").join(spark.createDataFrame([(r.id, r.file) for r in files], "id long, file string"), "id")
    assert {tuple(r) for r in sample.select("file", "k0", "k1").collect()} == {tuple(r) for r in ranked.where("at <= ceil(keys * 0.05)").select("file", "k0", "k1").collect()}


def test_bitmaps_are_sparks_own(spark):
    rows = spark.range(100_000).select(F.lit("f").alias("file"), F.col("id").alias("row"), F.when(F.col("id") % 5 > 0, F.xxhash64("id") % 3).alias("k0"))
    made = build.bitmaps(rows, ["k0"])
    assert "bitmap_construct_agg" not in made._jdf.queryExecution().optimizedPlan().toString()
    number = F.col("row") + 1
    want = rows.groupBy("file", "k0", F.bitmap_bucket_number(number).alias("bucket")).agg(F.count("*").alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))
    got = made.select("file", "k0", "bucket", "n", "bitmap")
    assert got.count() == want.count() > 12 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("mask", [1, 2, 3])
def test_bloom_bits_miss_no_key(spark, table, mask):
    index = table.catalog.index("ia")
    files, sample, bloom = (table_of(spark, table.catalog, index, x) for x in ("files", "sample", "bloom"))
    known = {r["file"]: r for r in gathered(list(read_rows(files.toArrow(), ["k0", "k1"])), sample.toArrow(), bloom.toArrow(), ["k0", "k1"])}
    hashed = lambda df: df.select("file", build.bloom_hash([F.col("k0"), F.col("k1")], mask).alias("h")).distinct().collect()
    entries = table_of(spark, table.catalog, index, "entries").where("k0 is not null")
    there = hashed(entries)
    assert all(may_hold(known[r.file], [r.h]) for r in there)
    absent = hashed(entries.select("file", (F.col("k0") + KEYS).alias("k0"), F.concat("k1", F.lit("x")).alias("k1")).limit(2000))
    assert sum(may_hold(known[r.file], [r.h]) for r in absent) <= 0.1 * len(absent)
