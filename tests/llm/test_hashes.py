"""Texts that collide under polynomial hashes, and what each operator makes of them."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from skimdex.llm import common, langid, line_dedup, pieces, quality, sentencepiece_codec, substring_dedup, token_files


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_thue_morse_words_do_collide_but_are_told_apart(n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    data, offsets = common.flat(pa.array([one, two]))
    prefix = common.prefix_hashes(common.BYTE_VALUE[data])
    assert len(set(common.span_hashes(prefix, offsets[:-1], offsets[1:]).tolist())) == 1
    assert common.codes(data, offsets[:-1], offsets[1:]).tolist() == [0, 1]
    assert not common.same_bytes(data, offsets[:1], data, offsets[1:2], np.array([n])).any()


@pytest.mark.parametrize("n", [1024, 4096])
def test_tokens_of_colliding_words(n):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    found = [f"x {thue_morse(n)} y", f"x {thue_morse(n, 'b', 'a')} y", f"x {thue_morse(n)} <|endoftext|>"]
    encoder, library = token_files.Encoder(path), Tokenizer.from_file(path)
    for texts in (found, found[1:], found[:1]):  # in one block, and against what is remembered
        ids, sizes = encoder(*common.flat(pa.array(texts)))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_sentencepiece_of_colliding_words():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    found = [thue_morse(1024), thue_morse(1024, "b", "a")]
    ids, sizes = codec(*common.flat(pa.array(found)))
    assert codec.decode(ids[: sizes[0]].tolist()) == found[0] and codec.decode(ids[sizes[0] :].tolist()) == found[1]
    assert codec(*common.flat(pa.array(found[1:])))[0].tolist() == ids[sizes[0] :].tolist()


def test_same_bytes():
    data = np.frombuffer(b"abcdefgh" * 8 + b"abcdefgX" * 8, np.uint8)
    for n in (0, 1, 7, 8, 9, 15, 16, 17, 40):
        got = common.same_bytes(data, np.array([0, 0, 1]), data, np.array([8, 64, 9]), np.array([n] * 3))
        assert got.tolist() == [True, n < 8, True]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 1 << 16)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    for i in range(20):
        codec(*common.flat(pa.array([" ".join(f"w{j}x" for j in range(i * 1000, i * 1000 + 1000))])))
        assert codec.held < (1 << 16) + 100_000


def test_quality_of_colliding_lines_and_words(spark):
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(0, f"{one}\n{two}"), (1, f"{one}\n{two}\n{one}"), (2, " ".join([*"cdefghi", one, *"cdefghi", two])), (3, " ".join([*"cdefghi", one, *"cdefghi", one]))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_dup_lines for i in range(4)] == [0, 1, 0, 0]
    assert [got[i].n_repeat_words for i in range(4)] == [0, 0, 0, 16]


def test_windows_with_equal_hashes_are_compared_by_words():
    words = np.array([1, 2, 3, 4, 1, 2, 5, 6])
    flat = np.zeros(len(words) + 1, np.uint64)  # every window has one hash
    first = np.arange(7)
    assert quality.repeated_windows(words, flat, np.zeros(8, np.int64), first, 2).tolist() == [True, False, False, False, True, False, False]


def test_substrings_that_collide(spark):
    one, two = thue_morse(4096), thue_morse(4096, "b", "a")
    rows = [(0, f"{one}!"), (1, f"?{two}")]
    seen, want = set(), {}
    for i, t in rows:
        gone = set()
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone |= set(range(s, s + 100))
            seen.add(t[s : s + 100])
        want[i] = (len(gone), hashlib.sha256("".join(c for j, c in enumerate(t) if j not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_letters_are_those_of_unicode():
    found = ["½ ²", "①", "Ⅷ", "12_3", "é", "語", "ʰ", "a"]
    assert langid.has_letter(*common.flat(pa.array(found))).tolist() == [False, False, False, False, True, True, True, True]


def test_very_long_texts(spark):
    """Several megabytes in one text, and a text of one word."""
    long = "".join(f"word{i % 70000} " + ("\n" if i % 40 == 0 else "") for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 3_000_000), (3, "short text")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[1].n_words == 400_000 and got[2].n_words == 1
    model = sentencepiece_codec.model_path()
    assert all(r.same for r in sentencepiece_codec.digests(df, model).collect())
    assert line_dedup.dedup(df).count() == 3
    assert {r.doc_id for r in langid.identify(df, None).collect()} == {1, 2, 3}
