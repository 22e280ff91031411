"""Queries that an index answers in its own order or from its keys alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .build import key_names
from .choose import Able, Candidate, satisfies
from .intervals import NULL
from .predicate import columns_of


def _entries(table, predicate: str, column: str, needs: Able) -> tuple[Candidate | None, DataFrame | None]:
    """The index led by ``column`` that can do what is needed for a predicate about that column alone, and its matching entries.

    Entries only if the index knows every file as it is now: none of a file that is gone or has changed. They have
    met the predicate itself, on the key.
    """
    if not predicate or columns_of(table.engine.spark, predicate) != {column.lower()}:
        return None, None
    found = table.scanner.candidates(table.scanner.compiled(predicate))
    c = next((c for c in found if c.index.columns[0].lower() == column.lower() and satisfies(c.index.kind, needs)), None)
    now = {f.path: f for f in table.files()}
    if c is None or not now or set(live := table.scanner.live(c, now)) != set(now):
        return c, None
    k, name = key_names(c.index)[0], c.index.columns[0]
    return c, table.scanner.entries(c, live).withColumnRenamed(k, name).where(predicate).withColumnRenamed(name, k)


def top_k(table, predicate: str, key: str, n: int, ascending: bool = True, columns: Sequence[str] | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """``WHERE predicate ORDER BY key LIMIT n``: the index says up to which key rows can matter.

    ``ties``: further columns to order by. Without a B-tree on the key alone, the plain plan.
    """
    order = [F.asc(key) if ascending else F.desc(key), *(F.asc(t) for t in ties)]
    c, entries = _entries(table, predicate, key, Able.ORDER) if n > 0 else (None, None)
    if entries is not None:
        k = F.col(key_names(c.index)[0])
        edge = entries.select(k.alias("k")).where("k is not null").orderBy(F.asc("k") if ascending else F.desc("k")).limit(n)
        row = edge.agg((F.max if ascending else F.min)("k").alias("edge"), F.count("*").alias("c")).first()
        nulls = any(i.null for i in table.scanner.compiled(predicate).ranges.get(key.lower(), [NULL]))
        if row.c == n and not (nulls and ascending):  # nulls would come first
            df, _ = table.scanner.scan(predicate)
            near = F.col(key) <= F.lit(row.edge) if ascending else F.col(key) >= F.lit(row.edge)
            return df.where(near).orderBy(*order).limit(n).select(*(columns or df.columns))
    df, _ = table.scanner.scan(predicate)
    return df.orderBy(*order).limit(n).select(*(columns or df.columns))


def semi_join(left: DataFrame, on: str, right, predicate: str, key: str, residual: str | None = None) -> DataFrame:
    """Rows of ``left`` whose ``on`` is a ``key`` of ``right`` rows that meet ``predicate``.

    Without a residual condition the right side is one row a key, read from an index on the key if one fits.
    Spark broadcasts it if its size at run time is below the session's threshold.
    """
    c, entries = (None, None) if residual else _entries(right, predicate, key, Able.EXISTENCE)
    if entries is not None:
        keys = entries.select(F.col(key_names(c.index)[0]).alias("_key")).distinct()
    else:
        keys = right.filter(" and ".join(f"({x})" for x in (predicate, residual) if x)).select(F.col(key).alias("_key")).distinct()
    return left.join(keys, left[on] == keys["_key"], "left_semi")


def group_by(table, predicate: str, key: str, **aggregates: Column) -> DataFrame:
    """``GROUP BY key`` over the rows that meet a predicate on it, scanned through the index."""
    return table.filter(predicate).groupBy(key).agg(*(a.alias(n) for n, a in aggregates.items()))


def count_by_key(table, predicate: str, key: str) -> DataFrame:
    """``key, n`` for each key in range: from the index alone where one covers the table."""
    c, entries = _entries(table, predicate, key, Able.GROUP)
    if entries is None or len(c.index.columns) > 1:
        return table.filter(predicate).groupBy(key).agg(F.count("*").alias("n"))
    return entries.groupBy(F.col(key_names(c.index)[0]).alias(key)).agg(F.sum("n").cast("long").alias("n"))


def first_rows(table, predicate: str, key: str, n: int = 1) -> DataFrame:
    """For each key in range, its first ``n`` rows in order of file and place: ``key, file, row``."""
    from pyspark.sql import Window

    c, entries = _entries(table, predicate, key, Able.ITERATE)
    if entries is None:
        raise ValueError(f"no index on {key} covers the table for {predicate!r}")
    k = F.col(key_names(c.index)[0])
    least = entries.select(k.alias(key), "file", F.explode(F.slice("rows", 1, n)).alias("row"))
    order = Window.partitionBy(key).orderBy("file", "row")
    return least.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n).drop("at")
