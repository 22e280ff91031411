"""Queries over indexed tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import table_of
from ..session import Engine, Table
from ..sources.workdir import workdir

#: Table name: source, derived columns, files, sort key, partition columns, and indexes (name: columns, kind).
LAYOUT = {
    "orders": ("orders", {"nk": "nullif(o_custkey % 10, 0)"}, 8, "o_custkey", (), {"by_customer": (["o_custkey"], "btree"), "by_status": (["o_orderstatus"], "bitmap"), "by_null": (["nk"], "btree"), "by_priority": (["o_orderpriority", "o_custkey"], "btree")}),
    "orders_desc": ("orders", {}, 4, "o_orderkey", (), {"by_key_down": (["o_orderkey desc"], "btree"), "by_date": (["o_orderdate"], "btree"), "by_price": (["o_totalprice"], "btree")}),
    "lineitem": ("lineitem", {}, 8, "l_suppkey", (), {"by_supplier": (["l_suppkey", "l_shipdate"], "btree"), "by_flag": (["l_returnflag"], "bitmap"), "by_supplier_only": (["l_suppkey"], "btree")}),
    "lineitem_many_files": ("lineitem", {}, 256, "l_suppkey", (), {"by_supplier": (["l_suppkey"], "btree")}),
    "part": ("part", {}, 4, "p_name", (), {"by_name": (["p_name"], "btree"), "by_size": (["p_size"], "bitmap")}),
    "orders_by_status": ("orders", {}, 2, "o_custkey", ("o_orderstatus",), {"in_part": (["o_custkey"], "btree")}),
    "orders_plain": ("orders", {}, 4, "o_custkey", (), {}),
    "customer": ("customer", {}, 4, "c_name", (), {"by_customer_name": (["c_name"], "btree"), "by_segment": (["c_mktsegment"], "bitmap")}),
}
_ready: dict[tuple[str, str, str], str] = {}


def prepared(spark: SparkSession, sf_dir: str, name: str, **conf) -> Table:
    """The table ``name`` over ``sf_dir``, written and indexed once per application."""
    source, derived, files, key, partitions, indexes = LAYOUT[name]
    at = (spark.sparkContext.applicationId, sf_dir, name)
    path = f"{workdir(spark)}/{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}/{name}"
    engine = Engine(spark, **conf)
    table = engine.table(path, name)
    if at not in _ready:
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet").withColumns({c: F.expr(e) for c, e in derived.items()})
        table.write(df, files=files, sort_by=[key], partition_by=partitions, mode="overwrite")
        for index, (columns, kind) in indexes.items():
            engine.create_index(index, table, columns, kind, if_not_exists=True)
        _ready[at] = path
    return table


_ORDERS = "(select *, nullif(o_custkey % 10, 0) as nk from orders)"
_O, _L = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority", "l_orderkey, l_linenumber, l_suppkey, l_returnflag"
#: name: (table, predicate, columns, settings); the oracle has the same predicate over the source table.
FILTERS: dict[str, tuple[str, str, str, dict]] = {
    "scan_project": ("orders_plain", "", "o_orderkey, o_totalprice", {}),
    "btree_eq": ("orders", "o_custkey = 77", _O, {}),
    "btree_range": ("orders", "o_custkey between 10 and 20", _O, {}),
    "btree_gt_lt_bounds": ("orders", "o_custkey > 10 and o_custkey <= 13", _O, {}),
    "btree_reversed_operands": ("orders", "20 >= o_custkey and 10 < o_custkey", _O, {}),
    "btree_in": ("orders", "o_custkey in (5, 7, 7, 1000, 999999)", _O, {}),
    "btree_or_ranges": ("orders", "o_custkey < 4 or o_custkey between 100 and 103 or o_custkey = 102", _O, {}),
    "btree_and_ranges": ("orders", "o_custkey > 30 and o_custkey < 10", _O, {}),
    "btree_is_null": ("orders", "nk is null", _O, {}),
    "btree_is_not_null": ("orders", "nk is not null", _O, {}),
    "btree_null_mixed": ("orders", "nk is null or nk = 3", _O, {}),
    "btree_prefix": ("part", "p_name like 'c%'", "p_partkey, p_name", {}),
    "btree_prefix_and_notnull": ("part", "p_name like 'b%' and p_name is not null", "p_partkey, p_name", {}),
    "btree_desc": ("orders_desc", "o_orderkey between 100 and 200", _O, {}),
    "btree_composite_eq_range": ("lineitem", "l_suppkey = 3 and l_shipdate >= timestamp '1996-01-01 00:00:00'", _L, {}),
    "btree_composite_eq_in": ("orders", "o_orderpriority = '1-URGENT' and o_custkey in (10, 11, 12, 13)", _O, {}),
    "btree_composite_prefix": ("orders", "o_orderpriority like '1%' and o_custkey < 20", _O, {}),
    "btree_string": ("customer", "c_name = 'Customer#000000007'", "c_custkey, c_name", {}),
    "btree_double": ("orders_desc", "o_totalprice > 400000.0", _O, {}),
    "btree_timestamp": ("orders_desc", "o_orderdate < timestamp '1995-03-01 00:00:00'", _O, {}),
    "bitmap_eq": ("orders", "o_orderstatus = 'F'", _O, {}),
    "bitmap_in": ("part", "p_size in (1, 2, 49)", "p_partkey, p_size", {}),
    "bitmap_null": ("customer", "c_mktsegment is null or c_mktsegment = 'BUILDING'", "c_custkey, c_mktsegment", {}),
    "bitmap_eq_or_range": ("part", "p_size = 1 or p_size > 45", "p_partkey, p_size", {}),
    "multi_index_and": ("lineitem", "l_suppkey between 2 and 6 and l_returnflag = 'R' and l_quantity > 10", _L, {"index.most": 2}),
    "residual_filter": ("lineitem", "l_suppkey between 2 and 4 and l_discount > 0.05", _L, {}),
    "or_two_columns": ("lineitem", "l_suppkey = 2 or l_returnflag = 'R'", _L, {}),
    "not_indexable": ("part", "p_name like '%e%' and p_size <> 3 and length(p_name) > 5", "p_partkey, p_name", {}),
    "skip_minmax": ("orders", "o_custkey > 100000000", _O, {}),
    "skip_bloom": ("orders_desc", "o_orderkey = -5 or o_orderkey = 999999999", _O, {}),
    "skip_empty_range": ("orders", "o_custkey >= 5 and o_custkey < 5", _O, {}),
    "policy_full_scan": ("orders", "o_custkey > 50", _O, {}),
    "partitioned_index": ("orders_by_status", "o_custkey between 10 and 30 and o_orderstatus = 'O'", _O, {}),
    "statistics_off": ("orders", "o_custkey between 40 and 42", _O, {"statistics.enabled": False}),
    "index_off": ("orders", "o_custkey between 43 and 45", _O, {"index.enabled": False}),
}


def _filter(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, predicate, columns, conf = FILTERS[name]
    spark_predicate = predicate.replace("timestamp '", "timestamp_ntz '")
    return lambda spark, sf: prepared(spark, sf, table, **conf).filter(spark_predicate or None, [c.strip() for c in columns.split(",")])


def _filter_sql(name: str) -> str:
    table, predicate, columns, _ = FILTERS[name]
    source = _ORDERS if table == "orders" else LAYOUT[table][0]
    return f"select {columns} from {source}" + (f" where {predicate}" if predicate else "")


def _rows_mode(spark: SparkSession, sf: str) -> DataFrame:
    table = prepared(spark, sf, "orders", **{"index.most": 2})
    return table.filter("o_custkey between 10 and 60 and o_orderstatus = 'F'", _O.split(", "), fetch="rows")


def _rows_btree(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf, "orders_desc").filter("o_orderkey in (1, 5, 32, 33)", _O.split(", "), fetch="rows")


def _disabled(spark: SparkSession, sf: str) -> DataFrame:
    table = prepared(spark, sf, "orders")
    table.engine.sql("disable sindex by_customer")
    return table.filter("o_custkey = 12", _O.split(", "))


def _show(spark: SparkSession, sf: str) -> DataFrame:
    engine = prepared(spark, sf, "orders").engine
    engine.sql("DISABLE OINDEX by_status")
    return engine.sql("SHOW OINDEX FROM orders")


def _check(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf, "orders").engine.sql("CHECK OINDEX ON orders").select(F.col("Analysis Result").alias("line"))


def _appended(refresh: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = spark.read.parquet(f"{sf}/orders.parquet")
        engine = Engine(spark)
        name = "appended_fresh" if refresh else "appended"
        table = engine.table(f"{workdir(spark)}/{hashlib.sha1(sf.encode()).hexdigest()[:12]}/{name}", name)
        table.write(df.where("o_orderkey % 3 > 0"), files=2, sort_by=["o_custkey"], mode="overwrite")
        table.catalog.save([])
        engine.sql(f"create sindex later on {name} (o_custkey)")
        table.write(df.where("o_orderkey % 3 = 0"), files=1, mode="append")
        if refresh:
            engine.sql(f"refresh sindex on {name}")
        return engine.sql(f"select o_orderkey, o_custkey from {name} where o_custkey between 10 and 20")

    return run


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    """The table-wide bounds and counts that the file statistics of an index add up to."""
    table = prepared(spark, sf, "orders")
    index = table.catalog.index("by_customer")
    files = spark.read.parquet(*(f"{table.catalog.root}/by_customer/{v}/files" for v in index.versions))
    return files.agg(F.min("low.k0").alias("low"), F.max("high.k0").alias("high"), F.sum("rows").cast("long").alias("n_rows"), F.sum("nulls").cast("long").alias("n_nulls"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each file's parts end at its row count, and its sample has the size it should."""
    table = prepared(spark, sf, "orders")
    files, sample = (table_of(spark, table.catalog, table.catalog.index("by_customer"), part) for part in ("files", "sample"))
    files = files.join(sample.groupBy("version", "id").agg(F.count("*").alias("sampled")), ["version", "id"], "left")
    fine = (F.element_at("parts", -1)["upto"] == F.col("rows")) & (F.coalesce("sampled", F.lit(0)) == F.greatest(F.ceil(F.col("keys") * 0.05), F.least(F.lit(24), F.col("keys"))))
    return files.agg(F.bool_and(fine).alias("fine"))


def _top(ascending: bool, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: prepared(spark, sf, "lineitem").top_k("l_suppkey > 3", "l_suppkey", 10, ascending, columns, ["l_orderkey", "l_linenumber"])


def _semi(residual: str | None, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
        right = prepared(spark, sf, "orders_desc")
        if kind == "anti":
            return orders.join(right.filter("o_orderkey < 14000").select(F.col("o_orderkey").alias("k")).distinct(), F.col("o_orderkey") == F.col("k"), "left_anti")
        return right.engine.semi_join(orders, "o_custkey", right, "o_orderkey < 40", "o_orderkey", residual)

    return run


def _grouped(**aggregates: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: prepared(spark, sf, "lineitem").group_by("l_suppkey >= 1", "l_suppkey", **{n: F.expr(a) for n, a in aggregates.items()})


_GROUP = "select l_suppkey, {} from lineitem where l_suppkey >= 1 group by l_suppkey"
#: name: (function, SQL or None)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "rowid_fetch_multi": (_rows_mode, f"select {_O} from orders where o_custkey between 10 and 60 and o_orderstatus = 'F'"),
    "rowid_fetch_btree": (_rows_btree, f"select {_O} from orders where o_orderkey in (1, 5, 32, 33)"),
    "disabled_index": (_disabled, f"select {_O} from orders where o_custkey = 12"),
    "ddl_show": (_show, "select * from (values ('orders', 'by_customer', 0, 'o_custkey', 'A', 'BTREE', true), ('orders', 'by_status', 0, 'o_orderstatus', 'A', 'BITMAP', false), ('orders', 'by_null', 0, 'nk', 'A', 'BTREE', true), ('orders', 'by_priority', 0, 'o_orderpriority', 'A', 'BTREE', true), ('orders', 'by_priority', 1, 'o_custkey', 'A', 'BTREE', true)) t(\"table\", key_name, seq_in_index, column_name, \"collation\", index_type, enabled)"),
    "ddl_check": (_check, "select '' as line where false"),
    "append_no_refresh": (_appended(False), "select o_orderkey, o_custkey from orders where o_custkey between 10 and 20"),
    "append_refresh": (_appended(True), "select o_orderkey, o_custkey from orders where o_custkey between 10 and 20"),
    "stats_minmax": (_stats, "select min(o_custkey) as low, max(o_custkey) as high, count(*) as n_rows, 0::bigint as n_nulls from orders"),
    "stats_parts_sample": (_parts, "select true as fine"),
    "topk_asc": (_top(True, ["l_suppkey", "l_orderkey", "l_linenumber"]), "select l_suppkey, l_orderkey, l_linenumber from lineitem where l_suppkey > 3 order by l_suppkey, l_orderkey, l_linenumber limit 10"),
    "topk_desc": (_top(False, ["l_suppkey", "l_orderkey", "l_linenumber"]), "select l_suppkey, l_orderkey, l_linenumber from lineitem where l_suppkey > 3 order by l_suppkey desc, l_orderkey, l_linenumber limit 10"),
    "topk_other_projection": (_top(True, ["l_partkey", "l_quantity"]), "select l_partkey, l_quantity from lineitem where l_suppkey > 3 order by l_suppkey, l_orderkey, l_linenumber limit 10"),
    "semi_distinct": (_semi(None, "semi"), "select o_orderkey, o_custkey from orders where o_custkey in (select o_orderkey from orders where o_orderkey < 40)"),
    "semi_right_filter": (_semi("o_orderstatus = 'F'", "semi"), "select o_orderkey, o_custkey from orders where o_custkey in (select o_orderkey from orders where o_orderkey < 40 and o_orderstatus = 'F')"),
    "anti_join": (_semi(None, "anti"), "select o_orderkey, o_custkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderkey < 14000)"),
    "group_min_max": (_grouped(low="min(l_quantity)", high="max(l_quantity)"), _GROUP.format("min(l_quantity) as low, max(l_quantity) as high")),
    "group_std_avg": (_grouped(mean="round(avg(l_quantity), 6)", spread="round(stddev(l_quantity), 6)"), _GROUP.format("round(avg(l_quantity), 6) as mean, round(stddev(l_quantity), 6) as spread")),
    "group_count_sum": (_grouped(n="count(*)", cents="cast(round(sum(l_extendedprice * 100)) as bigint)"), _GROUP.format("count(*) as n, cast(round(sum(l_extendedprice * 100)) as bigint) as cents")),
    "count_from_index": (lambda spark, sf: prepared(spark, sf, "lineitem").count_by_key("l_suppkey >= 1", "l_suppkey"), "select l_suppkey, count(*) as n from lineitem where l_suppkey >= 1 group by l_suppkey"),
    "first_row_per_key": (lambda spark, sf: prepared(spark, sf, "orders").first_rows("o_custkey >= 1", "o_custkey", 2).groupBy("o_custkey").agg(F.count("*").alias("n")), "select o_custkey, least(count(*), 2) as n from orders where o_custkey >= 1 group by o_custkey"),
    "join_inner_filtered": (lambda spark, sf: prepared(spark, sf, "orders").filter("o_custkey between 10 and 60").join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n")), "select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey where o_custkey between 10 and 60 group by c_mktsegment"),
}


def _fresh(spark: SparkSession, sf: str, name: str, **options) -> Table:
    """A table of its own for a query that changes what it reads."""
    engine = Engine(spark, **{"index.most": 2})
    table = engine.table(f"{workdir(spark)}/{hashlib.sha1(sf.encode()).hexdigest()[:12]}/{name}", name)
    table.write(spark.read.parquet(f"{sf}/orders.parquet"), mode="overwrite", **options)
    return table


def _half_known(spark: SparkSession, sf: str) -> DataFrame:
    """Row numbers of two indexes, of which only one knows a file that was appended between their builds."""
    df = spark.read.parquet(f"{sf}/orders.parquet")
    table = _fresh(spark, sf, "half_known", files=4, sort_by=["o_custkey"])
    table.engine.sql("create sindex first_one on half_known (o_custkey)")
    table.write(df.withColumn("o_orderkey", -F.col("o_orderkey")), files=1, mode="append")
    table.engine.sql("create sindex later_one on half_known (o_orderstatus) using bitmap")
    return table.filter("o_custkey between 10 and 60 and o_orderstatus = 'F'", _O.split(", "), fetch="rows")


def _file_removed(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """A partition's files are deleted behind the index's back; what is left must count, and no more."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        table = _fresh(spark, sf, f"removed_{kind}", files=4, sort_by=["o_custkey"], partition_by=["o_orderstatus"])
        table.engine.sql(f"create sindex by_cust on removed_{kind} (o_custkey)")
        table.catalog.store.delete(f"{table.path}/o_orderstatus=F")
        if kind == "count":
            return table.count_by_key("o_custkey >= 0", "o_custkey")
        if kind == "top":
            return table.top_k("o_custkey >= 0", "o_custkey", 10, True, ["o_custkey", "o_orderkey"], ["o_orderkey"])
        customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
        return table.engine.semi_join(customers, "c_custkey", table, "o_custkey >= 0", "o_custkey")

    return run


def _partition_ddl(spark: SparkSession, sf: str) -> DataFrame:
    """One index in two partitions, dropped in one of them: files of each partition that it still covers."""
    table = _fresh(spark, sf, "in_parts", files=2, sort_by=["o_custkey"], partition_by=["o_orderstatus"])
    for status in "FO":
        table.engine.sql(f"create sindex scoped on in_parts (o_custkey) partition (o_orderstatus = '{status}')")
    table.engine.sql("drop sindex scoped on in_parts partition (o_orderstatus = 'O')")
    index = table.catalog.index("scoped")
    rows = sorted({(f.partition(table.path)["o_orderstatus"], index.covers(f.partition(table.path))) for f in table.files()})
    return spark.createDataFrame(rows, "status string, covered boolean")


def _elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    """An index in a folder of its own, compressed with zstd, of a table with gzip, small row groups and Parquet's own filters."""
    at = f"{workdir(spark)}/{hashlib.sha1(sf.encode()).hexdigest()[:12]}"
    engine = Engine(spark, **{"index.directory": f"{at}/indexes", "index.codec": "zstd"})
    table = engine.table(f"{at}/elsewhere", "elsewhere")
    table.write(spark.read.parquet(f"{sf}/orders.parquet"), files=4, sort_by=["o_custkey"], mode="overwrite", compression="gzip", row_group_bytes=1 << 16, bloom_columns=["o_custkey"])
    engine.create_index("by_cust", table, ["o_custkey"], if_not_exists=True)
    engine.refresh_index(table)
    return table.filter("o_custkey in (3, 14, 15)", ["o_orderkey", "o_custkey"])


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What the engine says of its last scan, of a key that one of four files holds (whether it is looked up depends on sizes)."""
    table = _fresh(spark, sf, "measured", files=4, sort_by=["o_custkey"])
    table.catalog.save([])
    table.engine.sql("create sindex by_cust on measured (o_custkey)")
    table.filter("o_custkey = 1")
    return table.engine.metrics().select("files", "skipped", "used", "rows_known")


#: Statements that Catalyst plans through the indexes (Spark's text; DuckDB's is the same over the source tables).
STATEMENTS = {
    "sql_alias": ("orders_desc", "select t.o_orderkey, t.o_custkey from orders_desc t where t.o_orderkey = 33"),
    "sql_order_limit": ("orders_desc", "select o_orderkey, o_custkey from orders_desc where o_orderkey between 1000 and 3000 order by o_orderkey desc limit 7"),
    "sql_group_by": ("orders_desc", "select o_orderpriority, count(*) as n, max(o_custkey) as last from orders_desc where o_orderkey < 2000 group by o_orderpriority having count(*) > 1"),
    "sql_join": ("orders_desc", "select c.c_name, t.o_orderkey from customer_plain c join orders_desc t on c.c_custkey = t.o_custkey where t.o_orderkey between 100 and 400"),
    "sql_exists": ("orders_desc", "select c_custkey from customer_plain where exists (select 1 from orders_desc t where t.o_custkey = c_custkey and t.o_orderkey < 500)"),
    "sql_with_union": ("orders_desc", "with w as (select o_orderkey as k from orders_desc where o_orderkey < 40) select k from w union all select o_orderkey from orders_desc where o_orderkey > 14900"),
    "sql_no_filter": ("orders_desc", "select count(*) as n, min(o_orderkey) as low from orders_desc"),
}


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        table, text = STATEMENTS[name]
        engine = prepared(spark, sf, table).engine
        spark.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("customer_plain")
        return engine.sql(text)

    return run


_LEFT = "orders where o_orderstatus <> 'F'"
OTHERS |= {
    "rowid_half_known": (_half_known, f"select {_O} from (select * from orders union all select * replace (-o_orderkey as o_orderkey) from orders) where o_custkey between 10 and 60 and o_orderstatus = 'F'"),
    "removed_count_by_key": (_file_removed("count"), f"select o_custkey, count(*) as n from {_LEFT} group by o_custkey"),
    "removed_top_k": (_file_removed("top"), f"select o_custkey, o_orderkey from {_LEFT} order by o_custkey, o_orderkey limit 10"),
    "removed_semi_join": (_file_removed("semi"), f"select c_custkey from customer where c_custkey in (select o_custkey from {_LEFT})"),
    "literal_out_of_range": (lambda spark, sf: prepared(spark, sf, "part").filter("p_size in (3, 5000000000) or p_size > 5000000000", ["p_partkey", "p_size"]), "select p_partkey, p_size from part where p_size = 3"),
    "index_directory_codec": (_elsewhere, "select o_orderkey, o_custkey from orders where o_custkey in (3, 14, 15)"),
    "scan_metrics": (_metrics, "select 4 as files, 3 as skipped, 1 as used, count(*) as rows_known from orders"),
    "group_first_last": (_grouped(first_key="first(l_suppkey)", last_key="last(l_suppkey)"), _GROUP.format("l_suppkey as first_key, l_suppkey as last_key").replace("group by l_suppkey", "group by all")),
    "count_from_bitmap": (lambda spark, sf: prepared(spark, sf, "orders").count_by_key("o_orderstatus in ('F', 'P')", "o_orderstatus"), "select o_orderstatus, count(*) as n from orders where o_orderstatus in ('F', 'P') group by o_orderstatus"),
    "ddl_partitions": (_partition_ddl, "select distinct o_orderstatus as status, o_orderstatus = 'F' as covered from orders"),
} | {n: (_statement(n), text.replace("customer_plain", "customer").replace("orders_desc", "orders")) for n, (_, text) in STATEMENTS.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _filter(n) for n in FILTERS} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _filter_sql(n) for n in FILTERS} | {n: s for n, (_, s) in OTHERS.items() if s}
