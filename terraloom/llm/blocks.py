"""Blocks of rows: what one task reads at once, kept compressed until then.

A job that needs the same texts several times, with findings from the whole corpus in between, packs them into
blocks of bounded size and lets the findings come back by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terraloom.llm.text import SLICE_BYTES, bounded, release_memory, slices

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).min


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block`` (a number) and ``content`` (its rows, with all columns of ``docs``; one of them is ``text``)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in numbered(batches, block_bytes):
            yield _block(number, held)

    return bounded(docs).mapInArrow(pack, "block long, content binary")


def numbered(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The blocks of a task's rows: number and pieces."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for piece in slices(batch):
            held.append(piece)
            size += piece.column("text").nbytes
            if size >= block_bytes:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def _block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(held).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    content = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([content], pa.binary())], names=["block", "content"])


def unpacked(content: bytes) -> pa.Table:
    """The rows of a block in ascending order of ``doc_id``, nulls first; equal ids as they were read."""
    release_memory()
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(content)) as reader:
        table = reader.read_all()
    return table.take(np.argsort(ids(table), kind="stable")).combine_chunks()


def ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()


def row_slices(table: pa.Table, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows in pieces for numpy, of about ``limit`` bytes of text, each with the number of its first row."""
    at = 0
    for batch in table.to_batches():
        for piece in slices(batch, limit=limit):
            yield at, piece
            at += piece.num_rows
