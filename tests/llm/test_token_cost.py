"""What op2 spends on a text: no offsets, one hash for each distinct piece, one pass to pack ids."""

import time

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer, normalizers

from skimdex.llm import common, pieces, simple8b, token_files

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["the cat, the hat\n  don't stop \u0085 café 日本 \U0001f642!", None, "", " x<|endoftext|>y <|endoftext|> ", "é é <|endof text|>  \r\n"]


def same_as_library(encoder, library):
    ids, sizes = encoder(*common.flat(pa.array(TEXTS)))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_byte_level_ids_need_no_offsets(monkeypatch):
    encoder, library = token_files.Encoder(PATH), Tokenizer.from_file(PATH)

    class Quick:
        encode_batch_fast = staticmethod(library.encode_batch_fast)

    monkeypatch.setattr(encoder, "tokenizer", Quick)
    same_as_library(encoder, library)


def test_a_normalizer_that_changes_the_bytes(tmp_path):
    library = Tokenizer.from_file(PATH)
    library.normalizer = normalizers.NFD()
    library.save(str(tmp_path / "nfd.json"))
    same_as_library(token_files.Encoder(str(tmp_path / "nfd.json")), library)


def test_only_distinct_pieces_are_hashed(monkeypatch):
    hashed, prefix_hashes = [], pieces.prefix_hashes
    monkeypatch.setattr(pieces, "prefix_hashes", lambda values: hashed.append(len(values)) or prefix_hashes(values))
    ids, sizes = token_files.Encoder(PATH)(*common.flat(pa.array([" the cat" * 5000, "the cat" + " the cat" * 5000])))
    assert sizes.tolist() == [10000, 10002] and sum(hashed) < 100


def test_packing_ids_costs_little_more_than_unpacking():
    ids = (np.random.default_rng(0).zipf(1.2, 400_000) % 50257).astype(np.uint32)

    def least(f, x):
        took = []
        for _ in range(5):
            began = time.process_time()
            f(x)
            took.append(time.process_time() - began)
        return min(took)

    data = simple8b.encode(ids)
    assert (simple8b.decode(data) == ids).all()
    assert least(simple8b.encode, ids) < 4 * least(simple8b.decode, data)
