"""Writing tables so that indexes and file statistics have something to skip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, files: int | None = None, sort_by: Sequence[str] = (), partition_by: Sequence[str] = (), mode: str = "errorifexists", compression: str = "snappy", rows_per_file: int | None = None, row_group_bytes: int | None = None, bloom_columns: Sequence[str] = ()) -> None:
    """Writes ``df`` as Parquet; with ``sort_by``, range-partitioned so that each file covers a key range.

    ``files``: how many range partitions (the session's shuffle partitions if not given). ``mode``: append,
    overwrite, ignore or errorifexists. ``bloom_columns`` get Parquet's own bloom filters.
    """
    if sort_by:
        keys = [*partition_by, *sort_by]
        df = (df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    elif files:
        df = df.repartition(files)
    writer = df.write.mode(mode).option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    for column in bloom_columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
