"""Token files against the tokenizers library itself, and the word coding by round trips."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terraloom.llm import simple8b, token_files
from tests.llm.conftest import by_id

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**59)), max_size=700))
def test_words_round_trip(values):
    numbers = np.array(values, dtype=np.uint64)
    words, positions, escaped = simple8b.pack(numbers)
    assert simple8b.unpack(words, len(numbers), positions, escaped).tolist() == values


def test_rare_wide_values_are_escaped():
    numbers = np.array(([3] * 50 + [40_000]) * 40, dtype=np.uint32)
    words, positions, escaped = simple8b.pack(numbers)
    assert len(positions) == 40 and len(words) * 8 < len(numbers)
    assert simple8b.unpack(words, len(numbers), positions, escaped).tolist() == numbers.tolist()


@pytest.mark.parametrize("block_ids", [64, token_files.BLOCK_IDS])
def test_files_hold_every_id(spark, docs, no_docs, tmp_path, monkeypatch, block_ids):
    own = Tokenizer.from_file(TOKENIZER)
    monkeypatch.setattr(token_files, "BLOCK_IDS", block_ids)
    path = str(tmp_path / "tokens")
    token_files.write(docs, path, TOKENIZER, 2)
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids)
    got = token_files.digests(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(r.doc_id), *want[r.doc_id][:2]) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        assert r.start == at
        at += r.n_tokens
    for r in token_files.read(spark, path).collect():
        assert list(r.ids) == want[r.doc_id][2]
    empty = str(tmp_path / "none")
    token_files.write(no_docs, empty, TOKENIZER, 2)
    assert by_id(token_files.digests(spark, empty)) == []


def test_units_encode_as_the_whole(texts, monkeypatch):
    own, stored = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    tricky = ["a  b", " a", "a ", "a \n b", "x <|endoftext|> y", "　 a  b", "a\n b c", " ", "  ", "\t x y", "a b" * 50]
    for text in [t or "" for t in texts] + tricky:
        ids = np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert stored.encode(pa.array([text]))[0].astype("<u4").tobytes() == ids, text
    monkeypatch.setattr(token_files, "MAX_STORED", 500)
    together = token_files.Encoder(TOKENIZER).encode(pa.array([t or "" for t in texts] + tricky))
    for text, ids in zip([t or "" for t in texts] + tricky, together, strict=True):
        assert ids.tolist() == own.encode(text, add_special_tokens=False).ids
