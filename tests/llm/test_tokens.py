import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexgauge.llm import simple8b
from lexgauge.llm.pieces import Encoder
from lexgauge.llm.queries import BYTES, END_ID, WORDS
from tests.llm import plain


@given(
    st.lists(
        st.one_of(
            st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**32 - 1), st.integers(2**59, 2**64 - 1)
        ),
        max_size=3000,
    )
)
@settings(max_examples=60, deadline=None)
def test_round_trip(ids):
    given_ids = np.array(ids, np.uint64)
    words, blocks = simple8b.encode(given_ids)
    assert (simple8b.decode(words, len(ids), blocks) == given_ids).all()


def test_words_are_as_few_as_the_selectors_allow():
    ones = np.ones(simple8b.BLOCK, np.uint64)
    assert len(simple8b.encode(ones)[0]) == -(-simple8b.BLOCK // 60)
    zeros = np.zeros(960, np.uint64)
    assert len(simple8b.encode(zeros)[0]) == 4
    escapes = np.full(5, 2**64 - 1, np.uint64)
    assert len(simple8b.encode(escapes)[0]) == 10


def test_an_escaped_value_that_looks_like_an_escape():
    ids = np.array([2**63, 2**60, 16, 2**62, 0, 7], np.uint64)
    words, blocks = simple8b.encode(ids)
    assert (simple8b.decode(words, len(ids), blocks) == ids).all()


TEXTS = [
    *(t or "" for _, t, *_ in plain.odd_documents()),
    "it's  we'll\u00a0you\u3000x\u2028y", "e\u0301a \u0301b", "\x1cfile\x1fsep", "<|endoftext|> a", "İ ΣΑΣ", "ÀÉÎ ÿ ß µ ª º ×÷ x²³ ¼½",
    "a <|endoftext|> b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "nul\0nul !\0 ! \0", "Long" * 10 + " " + "é" * 17 + " !?" * 9 + "!" * 40,
    "exactlysixteen16 exactlysixteenab exactlysevenabcde", "\x85a\xa0b", "\xad soft", "1234 12.5e3 v2_x __", "a", " ", "\n",
]


@pytest.mark.parametrize("most", [3, 50, 1_000_000])
def test_pieces_give_the_ids_of_the_text(most):
    encoder, tokenizer = Encoder(WORDS, most=most), Tokenizer.from_file(WORDS)
    assert encoder.cuts
    for _ in range(2):
        for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([]) == []


ENCODER, TOKENIZER = Encoder(WORDS, most=200), Tokenizer.from_file(WORDS)


@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=255), st.characters(codec="utf-8")), max_size=60), max_size=8))
@settings(max_examples=400, deadline=None)
def test_any_texts(texts):
    for text, ids in zip(texts, ENCODER.encode(texts), strict=True):
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_characters_younger_than_this_python():
    texts = [f"A{chr(k)} {chr(k)}b 1{chr(k)}." for k in (0x13460, 0x10D4A, 0x1C89, 0xA7CB, 0x378, 0x1FAE9)]
    for text, ids in zip(texts, Encoder(WORDS).encode(texts), strict=True):
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_another_tokenizer_encodes_whole_texts():
    encoder, tokenizer = Encoder(BYTES), Tokenizer.from_file(BYTES)
    assert not encoder.cuts
    for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_many_pieces_in_one_text():
    text = " ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwxyz")
    (ids,) = Encoder(WORDS, most=10).encode([text])
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_known_pieces_when_the_table_grows():
    known = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop")
    new = " ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwxyz")
    encoder = Encoder(WORDS, most=100)
    for text in (known, f"{known} {new}", known):
        (ids,) = encoder.encode([text])
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_the_table_is_as_large_as_what_was_met():
    encoder = Encoder(WORDS)
    encoder.encode(["a few words"])
    small = encoder.table.slots
    text = " ".join(f"{a}{b}{c}{d}{e}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwxyz" for d in "aeiouy" for e in "klmnr")
    (ids,) = encoder.encode([text])
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert small <= 1 << 15 and 2 * encoder.table.size <= encoder.table.slots <= 1 << 17


def test_rows_of_a_file_are_read_one_by_one():
    ids = np.random.default_rng(1).integers(0, 49_000, simple8b.ROW_IDS).astype(np.uint64)
    words, blocks = simple8b.encode(ids)
    row = {
        "start": 0, "doc_ids": [7, None], "n_tokens": [len(ids) - 3, 3], "n_ids": len(ids),
        "words": words.astype("<u8").tobytes(), "block_words": blocks.astype("<u4").tobytes(),
    }
    kinds = {"doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int32())}
    table = {name: pa.array([value] * 100, kinds.get(name)) for name, value in row.items()}
    batch = pa.RecordBatch.from_pydict(table)
    tracemalloc.start()
    try:
        read = [r.column("ids_crc32").to_pylist() for r in simple8b._unpack(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    data = ids.astype("<u4").tobytes()
    assert read == [[zlib.crc32(data[:-12]), zlib.crc32(data[-12:])]] * 100
    assert peak < batch.nbytes


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
def test_files(spark, tmp_path, change):
    docs = change(plain.documents(spark))
    simple8b.write_tokens(docs, str(tmp_path / "t"), WORDS, END_ID)
    rows = simple8b.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(
        (d for d, *_ in plain.odd_documents()), key=lambda d: (d is not None, d)
    )
    tokenizer = Tokenizer.from_file(WORDS)
    expected = sorted(
        (d is not None, d or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID])
        for d, t, *_ in plain.odd_documents()
    )
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in rows)
    assert got == expected
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_empty(spark, tmp_path):
    simple8b.write_tokens(plain.documents(spark, []), str(tmp_path / "t"), WORDS, END_ID)
    assert simple8b.read_tokens(spark, str(tmp_path / "t")).count() == 0
