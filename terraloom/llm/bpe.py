"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut where no match of the splitting pattern can run across: before the last character of a run of white
space, which goes with what follows, and before and behind the rest of a long run, which is one match however long it
is and is merged as such without the pattern. The pieces give the same ids as the whole text. Decoding goes back to
raw bytes, so cuts inside a character do no harm.

Defined results: a null text is empty and has no ids; repeated rows are encoded each; runs may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.text import bounded, row_wise

#: Characters of a text that are encoded at once.
PIECE_CHARS = 1 << 16
#: White space of which so many characters follow each other is not given to the pattern, whose stack it would exhaust.
LONG_RUN = 1 << 12
_SAFE_CUT = regex.compile(r"\p{White_Space}(?=\P{White_Space})")
_LONG_RUN = regex.compile(r"\p{White_Space}{%d,}+" % LONG_RUN)
_loaded: dict[str, "Codec"] = {}


class Codec:
    """A rank file's encoding; one per worker process."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.digits = [b"%d" % i for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return self._encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece, whole in pieces(text):
            ids += self._encoding._encode_single_piece(piece) if whole else self._encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """``text`` cut around long runs of white space and at the first safe place after every ``size`` characters; each
    piece with whether it is one match."""
    start = 0
    for run in _LONG_RUN.finditer(text):
        yield from ((piece, False) for piece in _between(text, start, run.start(), size))
        start = run.end() - (run.end() < len(text))
        yield text[run.start() : start], True
    yield from ((piece, False) for piece in _between(text, start, len(text), size))


def _between(text: str, start: int, end: int, size: int) -> Iterator[str]:
    while end - start > size:
        cut = _SAFE_CUT.search(text, start + size, end)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if end > start:
        yield text[start:end]


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encoded(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id`` and the token ``ids`` of every text."""

    @F.arrow_udf(returnType="array<int>")
    def encode(column: pa.Array) -> pa.Array:
        own = codec(ranks)
        return pa.array([own.encode(text or "") for text in column.to_pylist()], pa.list_(pa.int32()))

    return bounded(docs).select("doc_id", encode(F.col("text").cast("string")).alias("ids"))


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """``doc_id`` and the raw ``bytes`` that the ``ids`` stand for; null ids give none."""

    @F.arrow_udf(returnType="binary")
    def decode(column: pa.Array) -> pa.Array:
        own = codec(ranks)
        return pa.array([own.decode(ids or []) for ids in column.to_pylist()], pa.binary())

    return bounded(tokens).select("doc_id", decode("ids").alias("bytes"))


def round_trip_digests(docs: DataFrame, ranks: str, with_ids: bool = False) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the bytes decoded from them, and maybe the ``ids``."""
    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    @F.arrow_udf(returnType="n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def digest(column: pa.Array) -> pa.Array:
        own = codec(ranks)

        def work(texts: pa.Array) -> list:
            rows = []
            for text in texts.to_pylist():
                ids = own.encode(text or "")
                names = hashlib.sha256(b",".join(map(own.digits.__getitem__, ids))).hexdigest()
                rows.append((len(ids), names, hashlib.sha256(own.decode(ids)).hexdigest(), np.array(ids, np.int32) if with_ids else None))
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(fields.values())]

        return row_wise(column, work, list(fields))

    return bounded(docs).select("doc_id", digest(F.col("text").cast("string")).alias("_d")).select("doc_id", "_d.*")
