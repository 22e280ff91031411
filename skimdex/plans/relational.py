"""The relational surface that Spark itself executes: one query for each family of operators.

``SAME`` holds SQL that Spark and DuckDB both run; ``PAIRS`` has a text for each; ``CALLS`` use the DataFrame API.
"""

from __future__ import annotations

import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.build import range_number, tile
from ..sources import relation
from ..sources.workdir import workdir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Rows that an aggregate in Python gets at once, and the power of two of keys that a range frame's block has.
STRETCH, BLOCK = 65536, 12
_CENTS = "cast(round(sum({} * 100)) as bigint)"

SAME = {
    "select_alias": "select o_orderkey as k, o_totalprice * 2 as twice from orders",
    "select_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "where_and_or_not": "select o_orderkey from orders where (o_orderstatus = 'F' or o_custkey < 100) and not o_orderpriority = '1-URGENT'",
    "star_qualified": "select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey",
    "agg_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12",
    "agg_global": f"select count(*) as n, {_CENTS.format('l_extendedprice')} as cents, min(l_shipdate) as first_day from lineitem",
    "agg_distinct": "select o_orderstatus, count(distinct o_custkey) as customers from orders group by o_orderstatus",
    "agg_rollup": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "agg_cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "agg_partial_final": f"select l_returnflag, l_linestatus, {_CENTS.format('l_quantity')} as q, {_CENTS.format('l_extendedprice')} as p, round(avg(l_discount), 6) as d, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "exists_query": "select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 49)",
    "not_exists_query": "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')",
    "in_query": "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)",
    "not_in_query": "select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 2)",
    "between_not_between": "select o_orderkey from orders where o_custkey between 5 and 50 and o_orderkey not between 100 and 9000",
    "in_list_not_in": "select n_name from nation where n_regionkey in (1, 2) and n_nationkey not in (3, 4)",
    "like_patterns": "select p_partkey from part where p_name like '%e_a%' and p_type not like 'S%'",
    "null_tests": "select k, k is null as missing from (select nullif(o_custkey % 10, 0) as k, o_orderkey from orders) t where k is null or o_orderkey < 20",
    "arithmetic": "select o_orderkey, -o_custkey as neg, o_custkey % 7 as m, o_custkey + 3 - 1 as s, o_totalprice / 4.0e0 as q from orders",
    "bitwise": "select o_orderkey, o_custkey & 12 as a, o_custkey | 3 as o, ~o_custkey as n from orders",
    "comparisons": "select o_orderkey from orders where o_custkey <> 7 and o_custkey != 9 and o_custkey >= 5 and o_custkey <= 900",
    "case_value": "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as state from orders",
    "case_searched": "select o_orderkey, case when o_totalprice > 300000 then 2 when o_totalprice > 100000 then 1 else 0 end as size from orders",
    "cast_types": "select o_orderkey, cast(o_custkey as varchar(20)) as t, cast(o_custkey as double) as d, cast('12' as int) as i from orders",
    "scalar_subquery": "select o_orderkey from orders where o_custkey = (select max(c_custkey) - 1 from customer)",
    "typed_literals": "select o_orderkey, date '2020-02-03' as d, 1.5e0 as f, true as b, 'x' as s from orders",
    "interval_literal": "select o_orderkey, cast(o_orderdate + interval '3' day as date) as d from orders",
    "join_inner": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey",
    "join_cross": "select r_name, n_name from region cross join nation",
    "join_comma": "select s_name, n_name from supplier, nation where s_nationkey = n_nationkey",
    "join_left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P'",
    "join_right": "select n_name, s_suppkey from (select * from supplier where s_acctbal > 5000) s right join nation on s_nationkey = n_nationkey",
    "join_full": "select a.n_name as left_name, b.n_name as right_name from (select * from nation where n_nationkey < 15) a full join (select * from nation where n_nationkey > 10) b on a.n_nationkey = b.n_nationkey",
    "join_using": "select k, n_name, r_name from (select n_regionkey as k, n_name from nation) a join (select r_regionkey as k, r_name from region) b using (k)",
    "join_natural": "select k, n_name, r_name from (select n_regionkey as k, n_name from nation) a natural join (select r_regionkey as k, r_name from region) b",
    "join_theta": "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey",
    "join_multiway": f"select n_name, {_CENTS.format('l_extendedprice')} as cents from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "win_rank": "select o_orderkey, rank() over (partition by o_custkey order by o_orderdate) as r, dense_rank() over (partition by o_custkey order by o_orderdate) as d, row_number() over (partition by o_custkey order by o_orderkey) as n from orders",
    "win_rows_frame": "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as n from orders",
    "win_range_frame": "select o_orderkey, count(*) over (order by o_orderkey range between 10 preceding and 5 following) as n from orders",
    "win_named": "select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey, 2) over w as after, first_value(o_orderkey) over w as first_key from orders window w as (partition by o_custkey order by o_orderkey)",
    "win_ntile": "select o_orderkey, ntile(7) over (order by o_orderkey) as t from orders",
    "order_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25",
    "order_nulls_first": "select k, o_orderkey from (select nullif(o_custkey % 10, 0) as k, o_orderkey from orders) t order by k asc nulls first, o_orderkey limit 15",
    "set_union": "select n_regionkey as k from nation union select r_regionkey from region",
    "set_union_all": "select n_regionkey as k from nation union all select r_regionkey from region",
    "set_intersect": "select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 0",
    "set_except": "select c_custkey as k from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'",
    "set_intersect_all": "select n_regionkey as k from nation intersect all select r_regionkey from region",
    "set_except_all": "select n_regionkey as k from nation except all select r_regionkey from region",
    "cte": "with big as (select * from orders where o_totalprice > 250000), n as (select o_custkey, count(*) as c from big group by o_custkey) select * from n where c > 1",
    "derived_table": "select t.k, t.n from (select o_custkey as k, count(*) as n from orders group by o_custkey) t where t.n = 10",
    "values_inline": "select * from (values (1, 'a'), (2, 'b'), (3, null)) t(k, v)",
    "fn_string": "select p_partkey, upper(p_name) as u, length(p_name) as n, substring(p_name, 2, 3) as s, concat(p_brand, '-', p_type) as c, replace(p_name, 'e', 'E') as r, trim(concat('  ', p_brand)) as t from part",
    "fn_math": "select o_orderkey, abs(o_custkey - 500) as a, floor(o_totalprice) as f, round(sqrt(o_totalprice), 6) as q, power(2.0e0, o_custkey % 5) as p from orders",
    "fn_conditional": "select o_orderkey, coalesce(nullif(o_custkey % 10, 0), -1) as c, greatest(o_custkey, 700) as g, least(o_custkey, 700) as l from orders",
}

PAIRS: dict[str, tuple[str, str]] = {
    "int_division": ("select o_orderkey, o_custkey div 7 as d from orders", "select o_orderkey, o_custkey // 7 as d from orders"),
    "bitwise_xor": ("select o_orderkey, o_custkey ^ 5 as x from orders", "select o_orderkey, xor(o_custkey, 5) as x from orders"),
    "rlike": ("select p_partkey from part where p_name rlike '^[a-m].*e$'", "select p_partkey from part where regexp_matches(p_name, '^[a-m].*e$')"),
    "null_safe_equal": ("select o_orderkey from (select o_orderkey, nullif(o_custkey % 10, 0) as k from orders) t where k <=> null", "select o_orderkey from (select o_orderkey, nullif(o_custkey % 10, 0) as k from orders) t where k is not distinct from null"),
    "join_semi": ("select c_custkey from customer left semi join orders on c_custkey = o_custkey", "select c_custkey from customer where c_custkey in (select o_custkey from orders)"),
    "join_anti": ("select c_custkey from customer left anti join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT'", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')"),
    "join_hints": ("select /*+ merge(c) */ count(*) as n from orders join customer c on o_custkey = c_custkey", "select count(*) as n from orders join customer c on o_custkey = c_custkey"),
    "join_hint_broadcast": ("select /*+ broadcast(n) */ s_suppkey, n_name from supplier join nation n on s_nationkey = n_nationkey", "select s_suppkey, n_name from supplier join nation n on s_nationkey = n_nationkey"),
    "join_hint_shuffle_hash": ("select /*+ shuffle_hash(c) */ c_mktsegment, count(*) as n from orders join customer c on o_custkey = c_custkey group by c_mktsegment", "select c_mktsegment, count(*) as n from orders join customer c on o_custkey = c_custkey group by c_mktsegment"),
    "partition_hints": ("select /*+ repartition(3, n_regionkey), rebalance(n_regionkey), coalesce(2) */ n_nationkey, n_regionkey from nation", "select n_nationkey, n_regionkey from nation"),
    "tablesample_rows": ("select count(*) as n from nation tablesample (7 rows)", "select 7::bigint as n"),
    "tablesample_bucket": ("select count(*) <= 25 as fine from nation tablesample (bucket 2 out of 5)", "select true as fine"),
    "transform_sql": ("select transform(n_nationkey, n_name) using 'cat' as (k string, name string) from nation", "select n_nationkey::varchar as k, n_name as name from nation"),
    "with_rollup_legacy": ("select o_orderstatus, count(*) as n from orders group by o_orderstatus with rollup", "select o_orderstatus, count(*) as n from orders group by rollup (o_orderstatus)"),
    "lateral_explode": ("select o_orderkey, x from orders lateral view explode(array(1, 2)) t as x", "select o_orderkey, unnest([1, 2]) as x from orders"),
    "lateral_explode_outer": ("select r_regionkey, x from region lateral view outer explode(if(r_regionkey = 1, array(), array(r_regionkey))) t as x", "select r_regionkey, case when r_regionkey = 1 then null else r_regionkey end as x from region"),
    "table_function": ("select id from range(3, 12, 2)", "select range as id from range(3, 12, 2)"),
    "table_statement": ("table region", "select * from region"),
    "tablesample_all": ("select count(*) as n from nation tablesample (100 percent)", "select count(*) as n from nation"),
    "row_constructor": ("select s.a as a, s.b as b from (select named_struct('a', n_nationkey, 'b', n_name) as s from nation)", "select n_nationkey as a, n_name as b from nation"),
    "sort_distribute_cluster": ("select n_nationkey from (select * from nation distribute by n_regionkey sort by n_name)", "select n_nationkey from nation"),
    "cluster_by": ("select n_nationkey from nation cluster by n_regionkey", "select n_nationkey from nation"),
    "fn_date": ("select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, cast(datediff(o_orderdate, date '1992-01-01') as bigint) as n, cast(date_trunc('month', o_orderdate) as date) as t, date_add(cast(o_orderdate as date), 5) as p from orders", "select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as d, date_diff('day', date '1992-01-01', o_orderdate::date) as n, date_trunc('month', o_orderdate)::date as t, (o_orderdate::date + 5)::date as p from orders"),
    "fn_array": ("select n_nationkey, size(a) as n, array_contains(a, 3) as c, a[1] as second, aggregate(transform(a, x -> x * 2), 0, (s, x) -> s + x) as total, element_at(slice(a, 2, 2), 1) as sl from (select n_nationkey, array(n_nationkey, n_regionkey, 3) as a from nation)", "select n_nationkey, 3::int as n, true as c, n_regionkey as second, (2 * (n_nationkey + n_regionkey + 3))::int as total, n_regionkey as sl from nation"),
    "fn_map_struct": ("select n_nationkey, map_keys(m)[0] as k, m['b'] as v from (select n_nationkey, map_from_arrays(array('a', 'b'), array(n_nationkey, n_regionkey)) as m from nation)", "select n_nationkey, 'a' as k, n_regionkey as v from nation"),
    "fn_json": ("select event_id, get_json_object(props, '$.k') as k from events", "select event_id, json_extract_string(props, '$.k') as k from events"),
    "fn_regex_split": ("select p_partkey, regexp_replace(p_name, '[aeiou]', '.') as r, split(p_type, ' ')[0] as s, startswith(p_name, 'a') as w from part", "select p_partkey, regexp_replace(p_name, '[aeiou]', '.', 'g') as r, string_split(p_type, ' ')[1] as s, starts_with(p_name, 'a') as w from part"),
    "fn_pmod": ("select o_orderkey, cast(pmod(o_custkey - 500, 7) as bigint) as p from orders", "select o_orderkey, ((o_custkey - 500) % 7 + 7) % 7 as p from orders"),
    "current_date_type": ("select count(*) as n from nation where current_date() > date '2000-01-01' and current_timestamp() is not null", "select count(*) as n from nation"),
}


def views(spark: SparkSession, sf: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        views(spark, sf)
        return spark.sql(text)

    return run


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _round_trip(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path, df = f"{workdir(spark)}/{kind}-{uuid.uuid4().hex}", _table(spark, sf, "nation")
        if kind == "text":
            df.select("n_name").write.text(path)
            return spark.read.text(path).select(F.col("value").alias("n_name"))
        options = {"header": "true"} if kind == "csv" else {}
        df.write.format(kind).options(**options).save(path)
        return spark.read.format(kind).schema(df.schema).options(**options).load(path)

    return run


def _partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic partitions, then one of them overwritten by a static partition insert."""
    path, name = f"{workdir(spark)}/parted-{uuid.uuid4().hex}", f"parted_{uuid.uuid4().hex}"
    views(spark, sf)
    spark.sql(f"create table {name} (k bigint, s string) using parquet partitioned by (s) location '{path}'")
    spark.sql(f"insert into {name} select o_orderkey, o_orderstatus from orders")
    spark.sql(f"insert overwrite table {name} partition (s = 'P') select o_orderkey from orders where o_orderkey < 100")
    out = spark.read.parquet(path).select("k", "s")
    spark.sql(f"drop table {name}")
    return out


def _multi_insert(spark: SparkSession, sf: str) -> DataFrame:
    views(spark, sf)
    names = [f"m{i}_{uuid.uuid4().hex}" for i in (1, 2)]
    paths = [f"{workdir(spark)}/{n}" for n in names]
    for n, p in zip(names, paths, strict=True):
        spark.sql(f"create table {n} (k int) using parquet location '{p}'")
    spark.sql(f"from nation insert into {names[0]} select n_nationkey where n_regionkey = 1 insert into {names[1]} select n_nationkey where n_regionkey = 2")
    out = spark.read.parquet(*paths)
    for n in names:
        spark.sql(f"drop table {n}")
    return out


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"b{i}_{uuid.uuid4().hex}" for i in (1, 2)]
    _table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.bucketBy(4, "o_custkey").sortBy("o_custkey").option("path", f"{workdir(spark)}/{names[0]}").saveAsTable(names[0])
    _table(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.bucketBy(4, "c_custkey").sortBy("c_custkey").option("path", f"{workdir(spark)}/{names[1]}").saveAsTable(names[1])
    return spark.table(names[0]).join(spark.table(names[1]).hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _udfs(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("long")
    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    spark.udf.register("skimdex_doubled", doubled)
    views(spark, sf)
    return spark.sql("select o_orderkey, skimdex_doubled(o_custkey) as twice from orders")


def _udaf(spark: SparkSession, sf: str) -> DataFrame:
    """In two steps, so that Python never holds a whole group: of stretches of ``STRETCH`` rows at most, then of what they gave."""

    @F.pandas_udf("double")
    def least(x: pd.Series) -> float:
        return float(x.min())

    @F.pandas_udf("double")
    def most(x: pd.Series) -> float:
        return float(x.max())

    @F.pandas_udf("double")
    def spread(low: pd.Series, high: pd.Series) -> float:
        return float(high.max() - low.min())

    rows = _table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.expr(f"monotonically_increasing_id() div {STRETCH}").alias("stretch"))
    parts = rows.groupBy("l_returnflag", "stretch").agg(least("l_quantity").alias("low"), most("l_quantity").alias("high"))
    return parts.groupBy("l_returnflag").agg(spread("low", "high").alias("spread"))


def _ntile(spark: SparkSession, sf: str) -> DataFrame:
    """SAME's text without a window over the whole table: rows are numbered in each range of keys, from where the ranges before it end."""
    path = f"{workdir(spark)}/ranges-{uuid.uuid4().hex}"
    _table(spark, sf, "orders").select("o_orderkey").repartitionByRange("o_orderkey").write.parquet(path)
    rows = spark.read.parquet(path).withColumn("p", range_number())
    order = Window.orderBy("p")  # a row for each range
    counts = rows.groupBy("p").agg(F.count("*").alias("c")).select("p", (F.sum("c").over(order) - F.col("c")).alias("before"), F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    at = F.row_number().over(Window.partitionBy("p").orderBy("o_orderkey")) + F.col("before")
    return rows.join(F.broadcast(counts), "p").select("o_orderkey", "total", at.alias("at")).select("o_orderkey", tile(F.col("at"), 7).alias("t"))


def _range_frame(spark: SparkSession, sf: str) -> DataFrame:
    """SAME's text without a window over the whole table: blocks of keys, each with the rows beside it that its frames reach."""
    key, low, high = F.col("o_orderkey"), 10, 5
    block, place = F.shiftright(key, BLOCK), key.bitwiseAND((1 << BLOCK) - 1)
    after, before = F.when(place >= (1 << BLOCK) - low, block + 1), F.when(place < high, block - 1)
    seen = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), *(F.struct(x.alias("block"), F.lit(False).alias("own")) for x in (after, before)))
    rows = _table(spark, sf, "orders").select("o_orderkey", F.inline(F.filter(seen, lambda x: x.own | x.block.isNotNull())))
    frame = Window.partitionBy("block").orderBy("o_orderkey").rangeBetween(-low, high)
    return rows.withColumn("n", F.count("*").over(frame)).where("own").select("o_orderkey", "n")


def _udtf(spark: SparkSession, sf: str) -> DataFrame:
    @F.udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for part in text.split(" "):
                yield (part,)

    spark.udtf.register("skimdex_parts", Parts)
    views(spark, sf)
    return spark.sql("select n_nationkey, part from nation, lateral skimdex_parts(n_name)")


def _transform(spark: SparkSession, sf: str) -> DataFrame:
    """What TRANSFORM scripts do, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"n_nationkey": x.n_nationkey, "tag": x.n_name.str[:2] + "!"})

    return _table(spark, sf, "nation").select("n_nationkey", "n_name").mapInPandas(run, "n_nationkey int, tag string")


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """File source, append-only file sink, every file once."""
    source, sink, done = (f"{workdir(spark)}/{x}-{uuid.uuid4().hex}" for x in ("in", "out", "seen"))
    _table(spark, sf, "events").select("event_id", "event_type").repartition(3).write.parquet(source)
    query = spark.readStream.schema("event_id long, event_type string").parquet(source).where("event_type <> 'click'").writeStream.format("parquet").option("path", sink).option("checkpointLocation", done).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


def _streamed_index(spark: SparkSession, sf: str) -> DataFrame:
    """A stream appended to an indexed table, whose index keeps up."""
    from ..session import Engine
    from ..streaming import append_stream

    root = f"{workdir(spark)}/landing-{uuid.uuid4().hex}"
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    engine = Engine(spark)
    table = engine.table(f"{root}/table", "landed")
    table.write(orders.where("o_orderkey % 2 = 0"), files=2, sort_by=["o_custkey"])
    engine.create_index("by_customer", table, ["o_custkey"])
    orders.where("o_orderkey % 2 = 1").write.parquet(f"{root}/in")
    append_stream(spark.readStream.schema(orders.schema).parquet(f"{root}/in"), table, f"{root}/seen").awaitTermination()
    return table.filter("o_custkey between 10 and 40")


def _socket(spark: SparkSession, sf: str) -> DataFrame:
    """Lines from a socket (Spark reads it on the driver), each once, to a file sink."""
    names = [r.n_name for r in _table(spark, sf, "nation").select("n_name").collect()]  # a fixed table of 25 rows
    root = f"{workdir(spark)}/socket-{uuid.uuid4().hex}"
    with socket.create_server(("127.0.0.1", 0)) as server:
        over = threading.Event()

        def serve() -> None:
            with server.accept()[0] as peer:
                peer.sendall("".join(f"{n}\n" for n in names).encode())
                over.wait(120)

        threading.Thread(target=serve, daemon=True).start()
        lines = spark.readStream.format("socket").option("host", "127.0.0.1").option("port", server.getsockname()[1]).load()
        query = lines.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/seen").start()
        until = time.monotonic() + 60
        try:
            while sum(p.numInputRows for p in query.recentProgress) < len(names) and time.monotonic() < until:
                query.processAllAvailable()
                time.sleep(0.1)
        finally:
            over.set()
            query.stop()
    return spark.read.schema("value string").parquet(f"{root}/out")


def _series(spark: SparkSession, sf: str) -> DataFrame:
    relation.register(spark)
    return spark.read.format("skimdex_series").option("end", 100_000).load().where("id >= 500 and id < 70000 and half is not null")


def _series_pruned(spark: SparkSession, sf: str) -> DataFrame:
    relation.register(spark)
    return spark.read.format("skimdex_series").option("start", 3).option("end", 2000).load().where("id = 44 or half > 990").select("half")


def _catalog(*steps: str, columns: tuple[str, ...] = ("*",)) -> Callable[[SparkSession, str], DataFrame]:
    """Statements in a database of their own, which is ``{db}``; the rows of the last one, of which there are few."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        views(spark, sf)
        db = f"skimdex_{uuid.uuid4().hex}"
        fill = lambda s: s.replace("{db}", db)
        spark.sql(f"create database {db} location '{workdir(spark)}/{db}'")
        try:
            for step in steps[:-1]:
                spark.sql(fill(step))
            last = spark.sql(fill(steps[-1])).select(*columns)
            return spark.createDataFrame(last.collect(), last.schema)
        finally:
            spark.sql("use default")
            spark.sql(f"drop database {db} cascade")

    return run


_NATION = "create table {db}.n using parquet as select * from nation"
_PARTED = "create table {db}.p using parquet partitioned by (r) as select n_nationkey as k, n_regionkey as r from nation"
#: Catalog and session statements: steps, and SQL for the rows of the last.
STATEMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "catalog_ctas": ((_NATION, "select * from {db}.n"), "select * from nation"),
    "catalog_like_rename": ((_NATION, "create table {db}.m like {db}.n", "alter table {db}.m rename to {db}.o", "insert into {db}.o select * from {db}.n where n_regionkey = 1", "select n_name from {db}.o"), "select n_name from nation where n_regionkey = 1"),
    "catalog_show_tables": ((_NATION, _PARTED, "drop table {db}.n", "drop table if exists {db}.n", "show tables in {db} like 'p'"), "select 'p' as tableName, false as isTemporary"),
    "catalog_columns": ((_NATION, "alter table {db}.n add columns (extra double)", "alter table {db}.n alter column extra comment 'more'", "show columns in {db}.n"), "select unnest(['n_nationkey', 'n_name', 'n_regionkey', 'extra']) as col_name"),
    "catalog_properties": ((_NATION, "alter table {db}.n set tblproperties ('a' = '1', 'b' = '2')", "alter table {db}.n unset tblproperties ('b')", "show tblproperties {db}.n ('a')"), "select 'a' as key, '1' as value"),
    "catalog_partitions": ((_PARTED, "alter table {db}.p add partition (r = 9)", "alter table {db}.p drop partition (r = 0)", "alter table {db}.p partition (r = 9) rename to partition (r = 8)", "show partitions {db}.p"), "select 'r=' || unnest([1, 2, 3, 4, 8]) as partition"),
    "catalog_recover": ((_PARTED, "msck repair table {db}.p", "alter table {db}.p recover partitions", "refresh table {db}.p", "select r, count(*) as n from {db}.p group by r"), "select n_regionkey as r, count(*) as n from nation group by n_regionkey"),
    "catalog_views": ((_NATION, "create view {db}.v as select n_name from {db}.n", "alter view {db}.v as select n_name, n_regionkey from {db}.n", "select * from {db}.v where n_regionkey = 2"), "select n_name, n_regionkey from nation where n_regionkey = 2"),
    "catalog_truncate": ((_NATION, "truncate table {db}.n", "insert into {db}.n select * from nation where n_nationkey < 3", "select n_nationkey from {db}.n"), "select n_nationkey from nation where n_nationkey < 3"),
    "catalog_analyze": ((_NATION, "analyze table {db}.n compute statistics for columns n_regionkey", "describe extended {db}.n n_regionkey"), "select * from (values ('col_name', 'n_regionkey'), ('data_type', 'int'), ('comment', 'NULL'), ('min', (select min(n_regionkey)::varchar from nation)), ('max', (select max(n_regionkey)::varchar from nation)), ('num_nulls', '0'), ('distinct_count', (select count(distinct n_regionkey)::varchar from nation)), ('avg_col_len', '4'), ('max_col_len', '4'), ('histogram', 'NULL')) t(info_name, info_value)"),
    "catalog_describe": ((_NATION, "describe table {db}.n"), "select unnest(['n_nationkey', 'n_name', 'n_regionkey']) as col_name, unnest(['int', 'string', 'int']) as data_type, null::varchar as comment"),
    "catalog_cache": ((_NATION, "cache table {db}.n", "uncache table {db}.n", "cache lazy table {db}.n", "clear cache", "select count(*) as n from {db}.n"), "select count(*) as n from nation"),
    "catalog_use": ((_NATION, "use {db}", "select max(n_nationkey) as last from n"), "select max(n_nationkey) as last from nation"),
    "catalog_set_reset": (("set spark.skimdex.tried = 7", "reset spark.skimdex.tried", "set spark.skimdex.tried = 8", "set spark.skimdex.tried"), "select 'spark.skimdex.tried' as key, '8' as value"),
    "catalog_function": (("create temporary function skimdex_next(x int) returns int return x + 1", "drop temporary function if exists skimdex_none", "select n_nationkey, skimdex_next(n_regionkey) as up from nation"), "select n_nationkey, (n_regionkey + 1)::int as up from nation"),
    # Which plan Spark picks is its own affair: no SQL.
    "catalog_explain": (("explain formatted select count(*) from nation",), None),
}
#: Of a statement's columns, those that don't name its database.
_SHOWN = {"catalog_show_tables": ("tableName", "isTemporary")}


CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    **{f"source_{k}": (_round_trip(k), "select n_nationkey, n_name, n_regionkey from nation" if k != "text" else "select n_name from nation") for k in ("parquet", "orc", "csv", "json", "text")},
    "insert_partitions": (_partitioned, "select o_orderkey as k, o_orderstatus as s from orders where o_orderstatus <> 'P' union all select o_orderkey, 'P' from orders where o_orderkey < 100"),
    "multi_insert": (_multi_insert, "select n_nationkey as k from nation where n_regionkey in (1, 2)"),
    "bucketed_join": (_bucketed, "select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by c_mktsegment"),
    "udf_scalar": (_udfs, "select o_orderkey, o_custkey * 2 as twice from orders"),
    "udf_aggregate": (_udaf, "select l_returnflag, max(l_quantity) - min(l_quantity) as spread from lineitem group by l_returnflag"),
    "udf_table": (_udtf, "select n_nationkey, unnest(string_split(n_name, ' ')) as part from nation"),
    "transform_script": (_transform, "select n_nationkey, substr(n_name, 1, 2) || '!' as tag from nation"),
    "stream_files": (_streamed, "select event_id, event_type from events where event_type <> 'click'"),
    "stream_socket": (_socket, "select n_name as value from nation"),
    "relation_filtered": (_series, "select range as id, range // 2 as half from range(500, 70000) where range % 2 = 0"),
    "relation_pruned": (_series_pruned, "select range // 2 as half from range(3, 2000) where range % 2 = 0 and (range = 44 or range // 2 > 990)"),
    "stream_indexed_table": (_streamed_index, "select o_orderkey, o_custkey from orders where o_custkey between 10 and 40"),
    "repartition_sort": (lambda s, sf: _table(s, sf, "nation").repartition(3, "n_regionkey").sortWithinPartitions("n_name").select("n_name"), "select n_name from nation"),
    "win_dataframe": (lambda s, sf: _table(s, sf, "events").select("event_id", F.sum(F.lit(1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("n")), "select event_id, count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as n from events"),
    "broadcast_semi": (lambda s, sf: _table(s, sf, "supplier").join(F.broadcast(_table(s, sf, "nation").where("n_regionkey = 1")), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey"), "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1)"),
}


#: Of SAME, those whose text would put the whole table into one task.
SPREAD = {"win_ntile": _ntile, "win_range_frame": _range_frame}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _sql(q) for n, q in SAME.items()} | SPREAD | {n: _sql(a) for n, (a, _) in PAIRS.items()} | {n: f for n, (f, _) in CALLS.items()} | {n: _catalog(*steps, columns=_SHOWN.get(n, ("*",))) for n, (steps, _) in STATEMENTS.items()}


def oracle_sql() -> dict[str, str]:
    return SAME | {n: b for n, (_, b) in PAIRS.items()} | {n: b for n, (_, b) in CALLS.items()} | {n: b for n, (_, b) in STATEMENTS.items() if b is not None}
