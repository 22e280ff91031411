"""Removal of repeated line runs with a suffix array over lines, built by distributed prefix doubling.

Every line with a word gets an id (the line's MD5, 128 bits); a document is the sequence of its lines' ids. A suffix's
rank at depth h is the place of its first h ids in the order of all suffixes' first h ids. Ranks at depth 2h
come from pairs of ranks at depth h, h lines apart. Each round counts the distinct pairs (combined before the
shuffle), range-partitions and sorts the distinct pairs only, adds running counts within and across partitions,
and joins the new ranks back; suffixes whose rank is theirs alone leave the rounds. No task sees all suffixes
or all copies of a line.

Suffixes of one rank at depth h are an interval of the suffix array whose common prefix is at least h lines. So
at h = ``min_run`` each interval of two or more is one run of lines and all its places: the first place in
order of (doc_id, line) stays, and the lines of the later ones go. Overlapping places make up the maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import batched, chunks, parts, released, written

_HAS_WORD = "[^\\x20\\x09-\\x0D]"
#: The rank of what follows a document's last line.
END = -1
#: In ``deduped_documents`` a line of more words than this is a passage, and a run by itself.
LONG_WORDS = 50


def _identity(line: Column) -> Column:
    """128 bits of a line: among 10**13 distinct lines, two with the same are expected in one of 10**12 corpora."""
    return F.unhex(F.md5(line.cast("binary")))


def line_ids(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc, pos, id)``: the lines of ``docs`` that have a word, numbered from 0 in each row."""
    held = F.filter(F.split(F.col(text).cast("string"), "\n", -1), lambda x: x.rlike(_HAS_WORD))
    return docs.select(F.col(key).alias("doc"), F.posexplode(F.transform(held, lambda x: _identity(x))).alias("pos", "id"))


def ranks(rows: DataFrame, by: list[str], rank: str = "rank", count: str = "count") -> DataFrame:
    """For each distinct ``by`` of ``rows``: the number of rows before it in their order, and of rows equal to it."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange(parts(rows.sparkSession), *by).sortWithinPartitions(*by)
    schema = counts.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            c = batch.column("c").to_numpy()
            ends = total + np.cumsum(c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - c), pa.array(np.full(len(c), part, np.int32))], [*batch.schema.names, "local", "part"])
            total = int(ends[-1]) if len(ends) else total
        released()

    local = written(ranged.mapInArrow(run, f"{schema.replace(',', ', ')}, local long, part int"), "ranks")
    totals = local.groupBy("part").agg(F.sum("c").alias("n"))  # one row a partition
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return local.join(F.broadcast(bases), "part").select(*by, (F.col("base") + F.col("local")).alias(rank), F.col("c").alias(count))


def suffix_ranks(lines: DataFrame, depth: int | None = None) -> DataFrame:
    """``(doc, pos, rank, count)`` of every suffix of ``lines (doc, pos, id)`` by its first ``depth`` ids.

    A shorter suffix ends in a mark below all ids. Without ``depth`` the rounds go on until nothing changes:
    the whole suffix array, where only suffixes that are equal to their ends share a rank.
    """
    now = written(lines.join(ranks(lines, ["id"]), "id").select("doc", "pos", "rank", "count"), "suffixes")
    reached = 1
    while depth is None or reached < depth:
        shared = now.where("count > 1")
        if shared.isEmpty():
            break
        ahead = reached if depth is None else min(reached, depth - reached)
        then = now.select("doc", (F.col("pos") - ahead).alias("pos"), F.col("rank").alias("then"))
        pairs = shared.join(then, shared.doc.eqNullSafe(then.doc) & (shared.pos == then.pos), "left").select(shared.doc, shared.pos, "rank", F.coalesce("then", F.lit(END)).alias("then"))
        # Counted among all shared suffixes; within one old rank the differences are those of the new order.
        # What is grouped is written before it is joined: a join of two plain shuffles can split a hot rank.
        order = ranks(pairs, ["rank", "then"], "order", "count")
        least = written(order.groupBy("rank").agg(F.min("order").alias("least")), "least")
        order = order.join(least, "rank").select(F.col("rank").alias("old"), F.col("then").alias("next"), (F.col("rank") + F.col("order") - F.col("least")).alias("finer"), "count")
        finer = pairs.join(order, (pairs.rank == order.old) & (pairs.then == order.next)).select("doc", "pos", F.col("finer").alias("rank"), "count")
        before = now
        now = written(finer.union(before.where("count = 1")), "suffixes")
        reached += ahead
        if depth is None and _settled(before, now):
            break
    return now


def _settled(before: DataFrame, now: DataFrame) -> bool:
    groups = [x.agg(F.count_distinct("rank")).first()[0] for x in (before, now)]
    return groups[0] == groups[1]


def repeated_runs(docs: DataFrame, min_run: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc, places)``: the line numbers at which a run of ``min_run`` lines starts that has an earlier place.

    Earlier is by (doc_id, line number), null ids first; rows that share an id share their places.
    """
    suffixes = suffix_ranks(line_ids(docs, text, key), min_run)
    size = suffixes.groupBy("doc").agg((F.max("pos") + 1).alias("lines"))
    place = F.struct("doc", "pos")
    shared = suffixes.where("count > 1")
    first = written(shared.groupBy("rank").agg(F.min(place).alias("first")), "firsts")
    later = shared.join(first, "rank").where(place > F.col("first")).select(F.col("doc").alias("d"), "pos")
    whole = later.join(size, later.d.eqNullSafe(size.doc)).where(F.col("pos") + min_run <= F.col("lines"))
    return whole.groupBy("doc").agg(F.collect_set("pos").alias("places"))  # at most a document's lines


def repeated_long_lines(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc, singles)``: the numbers of lines of over ``words`` words that have an earlier place, as in ``repeated_runs``."""
    held = F.filter(F.split(F.col(text).cast("string"), "\n", -1), lambda x: x.rlike(_HAS_WORD))
    count = lambda x: F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    long = lambda x: F.when(F.length(x) > 2 * words, count(x) > words).otherwise(F.lit(False))
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.transform(held, lambda x: F.when(long(x), _identity(x)))).alias("pos", "id")).where("id is not null")
    lines = written(lines, "long-lines")
    place = F.struct("doc", "pos")
    first = written(lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("id", "first"), "firsts")
    later = lines.join(first, "id").where(place > F.col("first"))
    return later.groupBy("doc").agg(F.collect_set("pos").alias("singles"))  # at most a document's lines


def _strip(text: str, places: list[int], min_run: int, singles: list[int]) -> tuple[str, int, int, int]:
    """The text without the runs at ``places``; how many lines with a word it had, lost, and in how many runs."""
    lines = text.split("\n")
    held = [i for i, line in enumerate(lines) if line.strip(" \t\n\r\x0b\x0c")]
    gone = np.zeros(len(held) + 1, bool)
    for p in places:
        gone[p : p + min_run] = True
    gone[np.array(singles, np.int64)] = True
    gone[len(held) :] = False
    drop = {held[i] for i in np.flatnonzero(gone).tolist()}
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
    return "\n".join(line for i, line in enumerate(lines) if i not in drop), len(held), len(drop), runs


def dedup(docs: DataFrame, min_run: int = 2, text: str = "text", key: str = "doc_id", long_words: int | None = None) -> DataFrame:
    """Rows ``(row, text, n_lines, n_removed, n_runs)``: the other columns of each row of ``docs`` as a struct, and its text without
    the later copies of runs of ``min_run`` or more lines, and of single lines of over ``long_words`` words.

    Only lines with a word count and go; blank lines stay. A null text stays null, with no lines. Ties: rows
    that share a doc_id are one place, so such repeats keep or lose their lines together. Other columns of
    ``docs``, whatever their names, are carried in ``row``. An empty table gives an empty result.
    """
    runs = repeated_runs(docs, min_run, text, key)
    others = [c for c in docs.columns if c != text]
    whole = batched(docs).select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    if long_words is None:
        runs = runs.withColumn("singles", F.lit(None).cast("array<int>"))
    else:
        both = runs.withColumn("singles", F.lit(None).cast("array<int>")).unionByName(repeated_long_lines(docs, long_words, text, key).withColumn("places", F.lit(None).cast("array<int>")))
        runs = both.groupBy("doc").agg(F.max("places").alias("places"), F.max("singles").alias("singles"))
    joined = whole.join(runs, F.col(f"row.{key}").eqNullSafe(runs.doc), "left").select("row", "t", "places", "singles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            texts, places, singles = (batch.column(c).to_pylist() for c in ("t", "places", "singles"))
            out = [_strip(t or "", p or [], min_run, s or []) for t, p, s in zip(texts, places, singles, strict=True)]
            kept = [None if t is None else o[0] for t, o in zip(texts, out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3))], ["row", "text", "n_lines", "n_removed", "n_runs"])

    kind = whole.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, text string, n_lines long, n_removed long, n_runs long")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def deduped_documents(docs: DataFrame, min_run: int = 2) -> DataFrame:
    """``docs`` with the texts that ``dedup`` leaves, in the same columns (n_chars follows the text).

    Later copies of a line of over ``LONG_WORDS`` words go even where its neighbours differ.

    Rows that lost every line are gone; rows that had none stay.
    """
    out = dedup(docs, min_run, long_words=LONG_WORDS).where("n_removed < n_lines or n_removed = 0")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


SQL = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
w as (select *, row_number() over (partition by doc_id order by i) as p, lead(line) over (partition by doc_id order by i) as nxt
  from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
r as (select doc_id, p, row_number() over (partition by line, nxt order by doc_id, p) as n from w where nxt is not null),
gone as (select distinct doc_id, p from (select doc_id, p from r where n > 1 union all select doc_id, p + 1 from r where n > 1)),
runs as (select doc_id, count(*) as n_removed, count(*) filter (where not adjoins) as n_runs
  from (select doc_id, coalesce(p - lag(p) over (partition by doc_id order by p) = 1, false) as adjoins from gone) group by doc_id),
sizes as (select doc_id, count(*) as n_lines from w group by doc_id),
left_over as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as kept
  from l left join w on l.doc_id = w.doc_id and l.i = w.i left join gone on gone.doc_id = w.doc_id and gone.p = w.p where gone.p is null group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join sizes using (doc_id) left join runs using (doc_id) left join left_over using (doc_id)
"""
