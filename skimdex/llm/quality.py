"""Quality rules by repetition coverage: how much of a text lies inside repeated n-grams and lines.

Words and lines of a block of texts are numbered by their bytes at once; polynomial prefix hashes over the word
numbers roll windows of every n-gram length in numpy. A sort brings windows of one text and one hash together,
neighbours are compared word by word, and counting runs gives the words, and so the characters, that repeated
windows cover.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, chunks, codes, flat, mixed, prefix_hashes, span_hashes, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Largest shares of a text's word characters that repeated n-grams (by n) and repeated lines may cover.

    Every occurrence of a repeated n-gram counts, the first included; of a repeated line the later ones count.
    The limits sit well above what ordinary prose with a few repeated lines reaches.
    """

    min_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    ngram_share: dict[int, float] = field(default_factory=lambda: {3: 0.60, 5: 0.40, 8: 0.30, 10: 0.28})
    line_share: float = 0.30


def repeated(items: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: whether its row has it twice or more, and whether an earlier place of its row has it."""
    twice, later = np.zeros(len(items), bool), np.zeros(len(items), bool)
    if len(items) > 1:
        order = np.lexsort((items, row))
        same = (items[order[1:]] == items[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        later[order[1:]] = same
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
    return twice, later


def repeated_windows(words: np.ndarray, rolled: np.ndarray, row: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Whether each window words[first:first+n] occurs twice or more in its row.

    ``rolled``: prefix hashes of ``words``. Windows of one hash are held against each other word by word; should
    two of them differ, windows are numbered by their words instead.
    """
    hashes = span_hashes(rolled, first, first + n)
    own = hashes ^ mixed(row[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    at = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    i, j = first[order[at]], first[order[at + 1]]
    if (row[i] != row[j]).any() or any((words[i + k] != words[j + k]).any() for k in range(n)):
        table = np.concatenate((row[first][:, None], words[first[:, None] + np.arange(n)]), 1)
        return repeated(np.unique(table, axis=0, return_inverse=True)[1].reshape(-1), row[first])[0]
    twice = np.zeros(len(first), bool)
    twice[order[at]] = twice[order[at + 1]] = True
    return twice


def covered(flags: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside a flagged window of ``n`` words; flags[i] is of the window that starts at word i."""
    total = np.zeros(words + n, np.int64)
    np.cumsum(flags, out=total[n : n + len(flags)])
    total[n + len(flags) :] = total[n + len(flags) - 1] if len(flags) else 0
    at = np.arange(words)
    return total[at + n] - total[at] > 0


def measure(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text: words, their characters, symbols, repeated lines, and what n-grams cover."""
    rows = len(offsets) - 1
    start, end, row = word_spans(data, offsets)
    heads = np.zeros(len(data) + 1, np.int64)  # code points begin at bytes that don't continue one
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    chars = heads[end] - heads[start]
    per_row = lambda weights, at=row: np.bincount(at, weights, rows).astype(np.int64)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": per_row(chars), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    words = codes(data, start, end)
    over = prefix_hashes(mixed(words.astype(np.uint64) + np.uint64(1)))
    for n in sizes:
        first = np.arange(max(0, len(words) - n + 1))
        whole = row[first] == row[first + n - 1] if len(first) else np.empty(0, bool)
        first = first[whole]
        flags = np.zeros(len(whole), bool)
        flags[first] = repeated_windows(words, over, row, first, n)
        inside = covered(flags, n, len(words))
        out[f"words_{n}"] = per_row(inside)
        out[f"chars_{n}"] = per_row(chars * inside)

    begins = np.zeros(len(data) + 1, bool)
    begins[1:] = data == 10
    begins[offsets[:-1]] = True
    line_start = np.flatnonzero(begins[:-1])
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_end = np.minimum(line_end, offsets[line_row + 1])
    ends_in_break = (line_end > line_start) & (data[line_end - 1] == 10) if len(line_start) else np.empty(0, bool)
    line_end = line_end - ends_in_break
    held = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)  # has a word
    line_start, line_end, line_row = line_start[held], line_end[held], line_row[held]
    later = repeated(codes(data, line_start, line_end), line_row)[1]
    out["n_dup_lines"] = per_row(later, line_row)
    in_words = np.zeros(len(words) + 1, np.int64)
    np.cumsum(chars, out=in_words[1:])
    held_chars = in_words[np.searchsorted(start, line_end)] - in_words[np.searchsorted(start, line_start)]
    out["line_chars"] = per_row(held_chars * later, line_row)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row ``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, worst_share)``
    for each row of ``docs``, repeated rows included.

    A null or empty text has no words, so ``base_failed`` is true and ``kept`` false. ``worst_share`` is the
    largest measured share over its limit (above 1 the text is rejected). Whole texts are measured, one at a
    time where a text is longer than a block. Other columns of ``docs`` are not looked at.
    """
    sizes = tuple(sorted({rules.base_window, *rules.ngram_share}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            got = measure(*flat(batch.column("t")), sizes)
            got["n_repeat_words"] = got[f"words_{rules.base_window}"]
            chars = np.maximum(got["word_chars"], 1)
            worst = got["line_chars"] / chars / rules.line_share
            for n, share in rules.ngram_share.items():
                worst = np.maximum(worst, got[f"chars_{n}"] / chars / share)
            failed = (got["n_words"] < rules.min_words) | (100 * got["n_repeat_words"] > rules.base_percent * got["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(~failed & (worst <= 1)), pa.array(worst)], ["k", *COUNTS, "base_failed", "kept", "worst_share"])

    kind = docs.schema[key].dataType.simpleString()
    out = batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, worst_share double")
    return out.withColumnRenamed("k", key)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns; judged in place, without a shuffle or join."""
    sizes = tuple(sorted({rules.base_window, *rules.ngram_share}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array(_passes(*flat(batch.column("text")), sizes, rules)))

    return batched(docs).mapInArrow(run, docs.schema)


def _passes(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], rules: Rules) -> np.ndarray:
    got = measure(data, offsets, sizes)
    chars = np.maximum(got["word_chars"], 1)
    ok = (got["n_words"] >= rules.min_words) & (100 * got[f"words_{rules.base_window}"] <= rules.base_percent * got["n_words"])
    ok &= got["line_chars"] <= rules.line_share * chars
    for n, share in rules.ngram_share.items():
        ok &= got[f"chars_{n}"] <= share * chars
    return ok


def op8(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(rules: Rules = Rules()) -> str:
    """What ``judge`` returns over ``documents``, in DuckDB's SQL; windows of words are joined by spaces, which no word has."""
    sizes = sorted({rules.base_window, *rules.ngram_share})
    ahead = lambda k: f"lead(word, {k}) over p" if k else "word"
    grams = ", ".join(f"case when {ahead(n - 1)} is not null then concat_ws(' ', {', '.join(ahead(k) for k in range(n))}) end as g{n}" for n in sizes)
    twice = ", ".join(f"g{n} is not null and count(*) over (partition by doc_id, g{n}) > 1 as twice{n}" for n in sizes)
    inside = ", ".join(f"bool_or(twice{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as in{n}" for n in sizes)
    sums = ", ".join(f"coalesce(sum(length(word)) filter (where in{n}), 0) as chars{n}" for n in sizes)
    worst = ", ".join(f"coalesce(chars{n}, 0)::double / most / {share}::double" for n, share in rules.ngram_share.items())
    return f"""
with w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents)),
g as (select doc_id, i, word, {grams} from w window p as (partition by doc_id order by i)),
t as (select doc_id, i, word, {twice} from g),
c as (select doc_id, word, {inside} from t),
words as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars, count(*) filter (where in{rules.base_window}) as n_repeat_words, {sums} from c group by doc_id),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
r as (select doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) as n, row_number() over (partition by doc_id, line order by i) > 1 as later
  from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lines as (select doc_id, count(*) filter (where later) as n_dup_lines, coalesce(sum(n) filter (where later), 0) as line_chars from r group by doc_id),
a as (select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, greatest(coalesce(word_chars, 0), 1)::double as most, coalesce(line_chars, 0)::double as line_chars, {", ".join(f"chars{n}" for n in sizes)}
  from documents d left join words using (doc_id) left join lines using (doc_id)),
v as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.base_percent} * n_words as base_failed,
    greatest(line_chars / most / {rules.line_share}::double, {worst}) as worst_share from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and worst_share <= 1 as kept, worst_share from v
"""


SQL = sql()
