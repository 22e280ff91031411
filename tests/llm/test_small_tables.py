"""Small scratch tables where Spark doesn't merge small partitions."""

import pytest

from skimdex.llm import common
from skimdex.llm.components import components


@pytest.fixture
def unmerged(spark):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_of_components_write_few_files(unmerged, monkeypatch):
    """500 links in chains of six nodes: each table of a round is one file, for which one task starts processes."""
    files, write = {}, common.written

    def counted(df, name, *args, **named):
        out = write(df, name, *args, **named)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr("skimdex.llm.components.written", counted)
    links = [(6 * c + i, 6 * c + i + 1) for c in range(100) for i in range(5)]
    found = components(unmerged.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {n: n - n % 6 for n in range(600)}
    assert set(files) == {"least", "links"} and all(n == 1 for many in files.values() for n in many)
    assert found.rdd.getNumPartitions() == 1


def test_large_tables_keep_their_partitions(unmerged, monkeypatch):
    rows = unmerged.range(1000).repartition(32, "id")
    assert common.packed(rows, 1000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(common, "FILE_ROWS", 100)
    assert common.packed(rows, 1000).rdd.getNumPartitions() == 10
    monkeypatch.setattr(common, "FILE_ROWS", 30)
    assert common.packed(rows, 1000).rdd.getNumPartitions() == 32
    assert sorted(r.id for r in common.packed(rows, 1000).collect()) == list(range(1000))
    unmerged.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert common.packed(rows, 10) is rows
