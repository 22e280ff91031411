"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skimdex.llm import ann, langid, line_dedup, mixing, pieces, quality, sentencepiece_codec, simhash, simple8b, substring_dedup, token_files, toxicity
from skimdex.llm.suffix_sort import Suffixes

from ..oracle import assert_same, connect

SF, WORD = "/root/testdata/sf0.001", re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k string"


def texts():
    r = random.Random(4)
    words = ["alpha", "beta", "gämma", "delta", "ε", "zeta", "#eta", "Theta", "iota", "kappa"]
    passage = " ".join(r.choice(words) for _ in range(40))
    out = [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(30)]
    out += [passage, f"one {passage} two", f"{passage}\n{passage}", None, None, "", "  ", "a" * 350, "ab" * 300, "\n\n", "l one\nl two\nl three", "x\nl one\nl two\ny", "l one\nl two", out[0], out[0]]
    return [*out, " ".join(r.choice(words) for _ in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 1, "clash", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints_and_components(docs):
    want = {}
    for i, t in enumerate(texts()):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in want}
    for _ in want:
        for i in want:
            root[i] = min(root[j] for j in want if (want[i] ^ want[j]).bit_count() <= 4)
    for hot in (4096, 2):
        got = {r.doc_id: (r.f0 % (1 << 64), r.component_id) for r in simhash.classes(docs, hot=hot).collect()}
        assert got == {i: (want[i], root[i]) for i in want}


def test_covering_masks_miss_no_pair_within_the_radius():
    r, masks = random.Random(1), simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(2000):
        x = sum(1 << b for b in r.sample(range(64), r.randrange(5)))
        assert any(not x & m for m in masks)


def test_near_dedup_keeps_one_of_each_group(spark):
    r = random.Random(2)
    base = [[f"w{r.randrange(5000)}" for _ in range(300)] for _ in range(20)]
    near = [[f"n{i}", *b[1:]] for i, b in enumerate(base)]
    rows = [(i, " ".join(w)) for i, w in enumerate([*base, *near])] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == [*range(20), 100, 101]


def test_near_dedup_removes_what_is_similar_and_nothing_else(spark):
    r, made = random.Random(7), []
    for _ in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(100)]
        made.append(base)
        for first, n in ((20, 6), (60, 7), (40, 12)):  # similarity 0.81, 0.79 and 0.71
            made.append([*base[:first], *(f"n{r.randrange(9**9)}" for _ in range(n)), *base[first + n :]])
    sets = [{tuple(w[j : j + 5]) for j in range(96)} for w in made]
    root = list(range(len(made)))
    near = [(a, b) for a in root for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in near:
        root[a] = root[b]
    gone = {i for i, x in enumerate(root) if x != i}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    for hot in (1024, 2):
        lost = set(range(len(made))) - {x.doc_id for x in simhash.near_dedup(df, hot=hot).collect()}
        assert lost <= gone and len(lost) >= 0.95 * len(gone) > 30


def test_hot_buckets_of_sampled_bits_lose_no_link(spark):
    r = random.Random(6)
    base = r.getrandbits(256)
    rows = [base ^ sum(1 << b for b in r.sample(range(256), 36)) for _ in range(160)]  # about 62 bits apart
    rows += [x ^ sum(1 << b for b in r.sample(range(256), 44)) for x in rows[:40]]
    cut = [tuple(simhash._SIGNED(x >> 64 * i & (1 << 64) - 1) for i in range(4)) for x in rows]
    prints = spark.createDataFrame([(n, *c, bytes(8)) for n, c in enumerate(cut)], "node long, f0 long, f1 long, f2 long, f3 long, shingles binary")
    masks = [sum((m % (1 << 64)) << 64 * i for i, m in enumerate(row)) for row in simhash.sampled_masks(64, 16, 4)]
    root = list(range(len(rows)))
    near = [(a, b) for a in root for b in range(a) if (rows[a] ^ rows[b]).bit_count() <= 48 and any(not (rows[a] ^ rows[b]) & m for m in masks)]
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    for hot in (1024, 2):
        at = {x.node: x.root for x in simhash.components(simhash.similar_links(prints, lambda nodes: prints.select("node", "shingles"), 4, 48, 64, 16, hot)).collect()}
        assert [at.get(n, n) for n in range(len(rows))] == root


def removed(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        raw, gone = (t or "").encode(), set()
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone |= set(range(s, s + length))
            seen.add(raw[s : s + length])
        kept = bytes(b for j, b in enumerate(raw) if j not in gone)
        out[i] = (len(raw), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(100, 32, 20_000), (12, 4, 3)])
def test_substring_dedup(docs, length, gram, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.strip(docs, length, gram=gram, hot_runs=hot).collect()}
    assert got == removed(enumerate(texts()), length)


def test_suffix_sort():
    data = np.frombuffer(b"abracadabra" * 30 + b"banana", np.uint8)
    starts = np.arange(len(data) - 20)
    order, shared = Suffixes(data, starts, 20).sort()
    raw = data.tobytes()
    assert order.tolist() == sorted(starts.tolist(), key=lambda s: (raw[s : s + 20], s))
    by_bytes = Suffixes(data, starts, 20).by_bytes()
    assert by_bytes[0].tolist() == order.tolist() and by_bytes[1].tolist() == shared.tolist()


def test_suffix_ranks_are_those_of_sorted_suffixes(spark):
    seqs = {0: [1, 2, 1, 2, 1], 1: [2, 1, 2], 2: [1, 2, 1, 2, 1], 3: [9]}
    df = spark.createDataFrame([(d, p, x) for d, s in seqs.items() for p, x in enumerate(s)], "doc long, pos int, id long")
    every = sorted(s[p:] for s in seqs.values() for p in range(len(s)))
    got = {(r.doc, r.pos): r["rank"] for r in line_dedup.suffix_ranks(df).collect()}
    assert got == {(d, p): every.index(s[p:]) for d, s in seqs.items() for p in range(len(s))}


def test_line_dedup(docs):
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        lines = (t or "").split("\n")
        held = [j for j, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a, b in zip(held, held[1:]):
            if (lines[a], lines[b]) in seen:
                gone |= {a, b}
            seen.add((lines[a], lines[b]))
        want[i] = (None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone))
    assert {r.row.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(docs).collect()} == want


def test_long_single_lines_that_repeat(spark):
    long, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    rows = [(0, f"a\n{long}\nb"), (1, f"c\n{long}\n\nd"), (2, long), (3, f"e\n{short}\nf"), (4, f"g\n{short}\nh"), (5, f"{long}\ni\n{long}"), (6, None)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in line_dedup.deduped_documents(df).collect()}
    assert got == {0: rows[0][1], 1: "c\n\nd", 3: rows[3][1], 4: rows[4][1], 5: "i", 6: None}


def test_simple8b_round_trip():
    r = random.Random(5)
    for n in (0, 1, 239, 240, 241, 256, 257, 5000):
        ids = np.array([r.choice([0, 0, 1, 2, 500, 50256, 2**30 - 1, 2**60 - 1, 2**60, 2**64 - 1]) if n < 5000 else r.randrange(50257) for _ in range(n)], np.uint64)
        data = simple8b.encode(ids)
        assert simple8b.decode(data).tolist() == ids.tolist()
        assert simple8b.decode(data, 1, 2).tolist() == ids[256:512].tolist()


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library, start, want = Tokenizer.from_file(path), 0, {}
    for i, t in enumerate(texts()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    token_files.write_tokens(docs, str(tmp_path / "f"), path)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, str(tmp_path / "f")).collect()} == {i: w[:3] for i, w in want.items()}
    assert {r.doc_id: r.ids for r in token_files.read_tokens(spark, str(tmp_path / "f")).collect()} == {i: w[3] for i, w in want.items()}


def test_special_tokens_in_a_text_are_those_of_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from skimdex.llm.common import flat

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library, found = Tokenizer.from_file(path), ["a <|endoftext|> b", "x<|endoftext|>y  <|endoftext|>\n<|endoftext|>", "<|endoftext|> <|endof text|>"]
    ids, sizes = token_files.Encoder(path)(*flat(pa.array(found)))
    want = [library.encode(t, add_special_tokens=False).ids for t in found]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_viterbi_is_the_best_split():
    v = sentencepiece_codec.codec(sentencepiece_codec.model_path()).v
    for text in ("▁the▁cat", "▁zzz🙂q", "▁▁▁a", "▁internationalisation▁of"):
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                known = v.pieces.get(text[start:end])
                score = known[1] if known else v.unknown_score if end == start + 1 else float("-inf")
                best[end] = max(best[end], best[start] + score)
        total, at = 0.0, sentencepiece_codec.viterbi(v, text)
        scores = {i: s for i, s in v.pieces.values()}
        run = 0
        for i in at:
            total += scores.get(i, 0.0)
            run += i not in scores and bytes(v.raw[i])[0] & 0xC0 != 0x80
        assert abs(total + run * v.unknown_score - best[-1]) < 1e-6
        assert sentencepiece_codec.viterbi(v, text * 40, portion=7) == sentencepiece_codec.viterbi(v, text * 40, portion=10_000)


def test_sentencepiece_round_trip(docs):
    model = sentencepiece_codec.model_path()
    got = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts())}


def test_piece_memory_starts_anew(monkeypatch):
    import pyarrow as pa

    from skimdex.llm.common import flat

    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    whole = [codec(*flat(pa.array([t])))[0].tolist() for t in texts()]
    monkeypatch.setattr(pieces, "MEMORY", 3)
    assert [codec(*flat(pa.array([t])))[0].tolist() for t in texts()] == whole


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    vectors = [v.tolist() for v in r.normal(size=(900, 8))]
    rows = list(enumerate(vectors)) + [(2000 + i, vectors[7]) for i in range(15)] + [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3100, [1.0, None]), (None, vectors[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("clash"))
    got = defaultdict(list)
    for x in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    fine = [(i, np.array(v)) for i, v in rows if i is not None and i < 3000]
    hits = total = 0
    assert set(got) == {i for i, _ in fine if i % 100 == 0}
    for q, found in got.items():
        at = dict(fine)[q]
        want = sorted((float(np.sqrt(((v - at) ** 2).sum())), i) for i, v in fine if i != q)[:10]
        assert found == sorted(found) and len(found) == 10
        hits, total = hits + len({i for _, i in found} & {i for _, i in want}), total + 10
    assert hits >= 0.9 * total


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {j + o for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for o in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))
        assert tuple(got[i][c] for c in quality.COUNTS) == want
        assert got[i].base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and (not got[i].base_failed or not got[i].kept)
    kept = sorted(r.doc_id for r in quality.keep(docs).collect())
    assert kept == sorted(i for i, r in got.items() if r.kept)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang is not null and length(text) > 40")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


def test_language_of_texts_without_letters(spark, docs):
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, ""), (4, "é")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.fit(docs)).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en"
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_toxicity_chain(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 > 0")
    chain = toxicity.fit(docs, train, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    rows = toxicity.score(docs, chain).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "is"), "doc_id").select("toxic", "is").collect()
    hit = sum(r.toxic and r["is"] == 1 for r in rows)
    assert hit >= 0.9 * sum(r["is"] == 1 for r in rows) and hit >= 0.9 * sum(r.toxic for r in rows)


def test_mixing_shares_shortages_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "z", 100)], "p0 string, p1 string, tokens long")
    got = {r.p1: r.budget for r in mixing.leaf_budgets(leaves, ["p0", "p1"], [{"a": 1, "b": 1}, {}], 100, 1).collect()}
    assert got == {"x": 10, "y": 40, "z": 50}


@pytest.mark.parametrize("name", ["op1_source_mixing", "op4_suffix_dedup", "op5_line_dedup", "op8_quality_rules"])
def test_sql(spark, name):
    from skimdex.llm import registry

    assert_same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


def test_empty_tables(spark, empty, tmp_path):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    model = sentencepiece_codec.model_path()
    for df in (simhash.classes(empty), simhash.near_dedup(empty), substring_dedup.strip(empty), line_dedup.dedup(empty), quality.judge(empty), quality.keep(empty), langid.identify(empty, langid.fit(empty)), sentencepiece_codec.encode(empty, model), mixing.mixed_documents(empty), ann.search(vectors, vectors)):
        assert df.count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f " * 20), (1, "a b c d e f " * 20), (1, "z"), (None, None)], "doc_id long, text string")
    assert simhash.classes(df).count() == substring_dedup.strip(df).count() == line_dedup.dedup(df).count() == quality.judge(df).count() == 4
    assert substring_dedup.strip(df).agg(F.sum("n_removed")).first()[0] > 200


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids"] and 0 < out.count() < 2 * docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = after
