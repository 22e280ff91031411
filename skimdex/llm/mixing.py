"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents are leaves' rows of a tree, domain over language over source. A token budget is shared out from the
root: the children of a node split its budget by their weights; a child that can't use its share (all its
tokens, ``max_epochs`` times) gives up the rest to its siblings. As a node's budget never exceeds what is
below it, a shortage moves to the siblings of a leaf first and further up only when they are full. Shares are
whole numbers and add up to the budget.

A leaf's budget is a prefix of an endless sequence: epoch 0 of its documents, epoch 1 and so on, each in the
order of md5(seed:epoch:doc_id). Whole epochs need no order. For the last one the leaf's order is cut into
4096 ranges of the hash, their sums show the range that holds the end, and only that range is sorted; the
place of the cut is then one hash per leaf. No task sorts or gathers a leaf, however large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A leaf table of at most so many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_LEAVES = 100_000
_WHOLE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        if weight <= 0 or weight != int(weight):
            raise ValueError(f"weights are positive whole numbers, not {weight}")
        out = F.when(F.col(column) == name, F.lit(int(weight))).otherwise(out)
    return out.cast(_WHOLE)


def _shared(nodes: DataFrame, parent: Sequence[str], own: str) -> DataFrame:
    """``budget`` for each row of ``nodes`` (parent.., own, cap, weight, above: the parent's budget)."""
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    order = group.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), own)
    so_far, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    full = nodes.withColumn("before", F.coalesce(F.sum("cap").over(so_far), F.lit(0)).cast(_WHOLE)).withColumn("ahead", F.sum("weight").over(ahead).cast(_WHOLE))
    full = full.withColumn("full", F.col("cap") * F.col("ahead") <= (F.col("above") - F.col("before")) * F.col("weight"))
    open_weight = F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))
    full = full.withColumn("left", (F.col("above") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(group)).cast(_WHOLE))
    full = full.withColumn("total", F.sum(open_weight).over(group).cast(_WHOLE)).withColumn("upto", F.sum(open_weight).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(_WHOLE))
    share = F.expr("left * upto div total") - F.expr("left * (upto - weight) div total")
    return full.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share).cast(_WHOLE)).select(*nodes.columns, "budget")


def leaf_budgets(leaves: DataFrame, path: Sequence[str], weights: Sequence[Mapping[str, int]], budget: int | None, max_epochs: int) -> DataFrame:
    """``leaves (path.., tokens)`` with each leaf's ``budget`` in tokens; null ``budget``: all tokens once."""
    nodes = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(_WHOLE))
    everything = Window.partitionBy(F.lit(0))
    above = None
    for depth, own in enumerate(path):
        up = list(path[:depth])
        level = nodes.groupBy(*up, own).agg(F.sum("cap").cast(_WHOLE).alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(own, weights[depth]))
        if above is None:
            wanted = F.sum("tokens").over(everything) if budget is None else F.lit(int(budget))
            level = level.withColumn("above", F.least(wanted.cast(_WHOLE), F.sum("cap").over(everything).cast(_WHOLE)))
        else:
            level = level.join(above, up)
        shared = _shared(level, up, own)
        above = shared.select(*up, own, F.col("budget").alias("above"))
    return shared.select(*path, "tokens", F.col("budget").cast("long").alias("budget"))


def _keyed(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def leaf_cuts(thin: DataFrame, path: Sequence[str], weights: Sequence[Mapping[str, int]], budget: int | None, max_epochs: int, seed: int) -> DataFrame:
    """For each leaf: ``epochs`` taken whole, and ``cut``: the last md5 key of the epoch after them (or null)."""
    leaves = written(thin.groupBy(*path).agg(F.sum("n").alias("tokens")), "leaves")
    shared = leaf_budgets(leaves, path, weights, budget, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    shared = written(shared.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    docs = thin.join(_sized(shared.where("rest > 0").select(*path, "epochs", "rest")), list(path)).withColumn("key", _keyed(seed, F.col("epochs"), F.col("k"))).withColumn("range", F.substring("key", 1, 3))
    order = Window.partitionBy(*path).orderBy("range")
    sums = docs.groupBy(*path, "range").agg(F.sum("n").alias("sum"), F.first("rest").alias("rest")).withColumn("before", F.sum("sum").over(order) - F.col("sum"))
    last = sums.where("before < rest and before + sum >= rest").select(*path, "range", "before")
    inside = docs.join(_sized(last), [*path, "range"])
    upto = Window.partitionBy(*path).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(*path, "key")
    start = F.col("before") + F.sum("n").over(upto) - F.sum("n").over(own)
    cuts = inside.withColumn("start", start).where("start < rest").groupBy(*path).agg(F.max("key").alias("cut"))
    return shared.join(cuts, list(path), "left").select(*path, "epochs", "cut")


def _sized(leaves: DataFrame) -> DataFrame:
    """``leaves``, marked for broadcast if a count shows that it is small."""
    leaves = written(leaves, "leaf-rows")
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _named(docs: DataFrame, path: Sequence[Column], key: str) -> DataFrame:
    """Path columns p0.. (null as empty text) and k, the key as text, with the whole row beside them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.coalesce(c.cast("string"), F.lit("")).alias(f"p{i}") for i, c in enumerate(path)), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"))


def mix(docs: DataFrame, path: Sequence[Column], weights: Sequence[Mapping[str, int]], budget: int | None = None, max_epochs: int = 4, seed: int = 17, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` once for each epoch that takes them: ``row`` (struct), p0, p1, .., ``epoch``, ``n_tokens``.

    ``path``: the tree's levels from the top; ``weights``: for each level, positive whole weights by name
    (1 where a name has none). A document belongs to the prefix if its first token does, so a leaf exceeds its
    budget by less than one document. Tokens are words. Null levels count as empty text, null texts have no
    tokens (they are taken while their leaf's prefix reaches them). Rows with one key are taken together. An
    empty table gives an empty result. Whatever other columns are called, they are carried in ``row``.
    """
    names = [f"p{i}" for i in range(len(path))]
    named = _named(docs, path, key).withColumn("n", word_count(F.col(f"row.{text}")))
    cuts = leaf_cuts(written(named.select(*names, "k", "n"), "token-counts"), names, weights, budget, max_epochs, seed)
    taken = named.join(_sized(cuts), names)
    copies = F.col("epochs") + F.when(_keyed(seed, F.col("epochs"), F.col("k")) <= F.col("cut"), 1).otherwise(0)
    taken = taken.withColumn("copies", copies).where("copies > 0")
    return taken.select("row", *names, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"), F.col("n").alias("n_tokens"))


#: Production weights. The domain of a source is told from its number.
DOMAIN = "case when source is null then '' else elt(cast(pmod(cast(regexp_extract(source, '[0-9]+', 0) as int), 3) as int) + 1, 'web', 'books', 'code') end"
WEIGHTS = ({"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {})


def documents_path() -> list[Column]:
    return [F.expr(DOMAIN), F.col("lang"), F.col("source")]


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mix(docs, documents_path(), WEIGHTS)
    return out.select("row.doc_id", F.col("p0").alias("domain"), F.col("p1").alias("lang"), F.col("p2").alias("source"), "epoch", "n_tokens")


def mixed_documents(docs: DataFrame, max_epochs: int = 2) -> DataFrame:
    """``docs`` with its rows taken as often as their leaf's budget says, in the columns it came with."""
    return mix(docs, documents_path(), WEIGHTS, max_epochs=max_epochs).select("row.*")


_LEVEL = """
{name}_l as (select {path}, sum(cap) as cap, sum(tokens) as tokens, {weight} as w from leaves group by {path}),
{name}_b as (select {name}_l.*, {above} as above from {name}_l {join}),
{name}_o as (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (o rows between current row and unbounded following) as ahead
  from {name}_b window o as (partition by {up} order by cap::double / w::double, {own})),
{name}_f as (select *, cap * ahead <= (above - before) * w as f from {name}_o),
{name}_g as (select *, above - sum(case when f then cap else 0 end) over (partition by {up}) as lft,
    sum(case when f then 0 else w end) over (partition by {up}) as tot,
    sum(case when f then 0 else w end) over (partition by {up} order by cap::double / w::double, {own} rows between unbounded preceding and current row) as upto
  from {name}_f),
{name} as (select *, case when f then cap else (lft * upto) // tot - (lft * (upto - w)) // tot end as budget from {name}_g),"""
_D, _L = "case p0 when 'web' then 5 when 'books' then 3 when 'code' then 2 else 1 end", "case p1 when 'en' then 6 when 'de' then 2 when 'fr' then 2 when 'es' then 1 else 1 end"
SQL = (
    """
with thin as (select doc_id, coalesce(doc_id::varchar, '') as k, coalesce(lang, '') as p1, coalesce(source, '') as p2,
    case when source is null then '' else list_extract(['web', 'books', 'code'], (regexp_extract(source, '[0-9]+')::bigint % 3 + 1)::bigint) end as p0,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n from documents),
leaves as (select p0, p1, p2, sum(n)::hugeint as tokens, 4 * sum(n)::hugeint as cap from thin group by all),"""
    + _LEVEL.format(name="d", path="p0", weight=f"({_D})::hugeint", above="least((select sum(tokens) from leaves), (select sum(cap) from leaves))", join="", up="0", own="p0")
    + _LEVEL.format(name="g", path="p0, p1", weight=f"({_L})::hugeint", above="d.budget", join="join d using (p0)", up="p0", own="p1")
    + _LEVEL.format(name="s", path="p0, p1, p2", weight="1::hugeint", above="g.budget", join="join g using (p0, p1)", up="p0, p1", own="p2")
    + """
b as (select p0, p1, p2, case when tokens > 0 then budget // tokens else 0 end as epochs, budget, tokens from s),
keyed as (select thin.*, epochs, budget - epochs * tokens as rest, md5('17:' || epochs::varchar || ':' || k) as h from thin join b using (p0, p1, p2)),
placed as (select *, sum(n) over (partition by p0, p1, p2 order by h range between unbounded preceding and current row) - sum(n) over (partition by p0, p1, p2, h) as start from keyed),
counted as (select *, epochs + case when start < rest then 1 else 0 end as copies from placed)
select doc_id, p0 as domain, p1 as lang, p2 as source, e::int as epoch, n as n_tokens
from (select *, unnest(range(copies::bigint)) as e from counted)
"""
)
