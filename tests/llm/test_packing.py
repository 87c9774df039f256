import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import packing

SCHEMA = "doc_id long, text string, length int, sequence_id string"  # the last two clash with names of the result


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids + [0] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TEXTS = [
    "Tere, maailm! It's  two  spaces", "", None, "a \n b", "x\x85 y", "word " * 3000, "üõäö\tşş 123 4567 <|endoftext|> €€", " lead", "\n\n  tail  ", "one",
    "a  b\x1f c  d", "don't we'll I'm 'tis " * 30,
]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(9, "one", 7, "x")], SCHEMA)
    return packing.pack(docs, with_ids=True).collect()


def test_ids_are_the_tokenizer_s(packed):
    want = ids_of(TEXTS)
    for i, ids in enumerate(want):
        own = sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["start"])
        copies = 2 if i == 9 else 1
        assert sorted(x for r in own for x in r["ids"]) == sorted(ids * copies)
        for r in own:
            assert list(r["ids"]) == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes())


def test_sequences_are_gapless_and_within_capacity(packed):
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_padded_sequences(spark, packed):
    pieces = spark.createDataFrame(packed, packing.PIECES_WITH_IDS)
    rows = packing.sequences(pieces).collect()
    for r in rows:
        own = sum(r["lengths"])
        assert own <= packing.CAPACITY and len(r["input_ids"]) == (own if own & (own - 1) == 0 else packing.CAPACITY)
    short = packing.sequences(packing.pack(spark.createDataFrame([(1, "a b c", 7, "x")], SCHEMA), with_ids=True)).first()
    assert len(short["input_ids"]) == 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a", " the", "é", "12", "'s", "\u00a0"]), max_size=12).map("".join), min_size=1, max_size=5))
def test_ids_of_texts_with_special_strings(texts):
    import public_tokenizers

    encoder = packing.TextEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.SPECIALS)
    ids, firsts = encoder.encode_texts(pa.array(texts, pa.string()))
    assert [[*ids[a:b].tolist(), 0] for a, b in zip(firsts, firsts[1:], strict=False)] == ids_of(texts)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_is_the_brute_force_s(lengths):
    window, offset, count = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    rest = []
    for length in sorted(lengths, reverse=True):
        fitting = [x for x in rest if x >= length]
        if fitting:
            rest.remove(min(fitting))
            rest.append(min(fitting) - length)
        else:
            rest.append(64 - length)
    used = np.bincount(window, weights=lengths, minlength=count) if lengths else []
    assert sorted(64 - np.array(used)) == sorted(rest)
