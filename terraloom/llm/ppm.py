"""Scores of a language model by prediction by partial matching over bytes.

A symbol is coded in the longest known context of at most ``ORDER`` bytes; an unseen one escapes to the next
shorter context (method C: a context of n symbols of d kinds escapes with d / (n + d)), where the symbols of the
longer one are excluded. Below the empty context all symbols are equally likely. A text begins in a context of
its own and ends with an end symbol, so the model is a distribution over whole texts.

Trained on a corpus, the context trie is a table of counts per (context, symbol) of full order; shorter contexts
are sums over it. A context's kinds, and the mass that its symbols have one order below, are aggregates of joins,
so the code length of every distinct (context, symbol) is worked out once, on Spark, whatever the trie's size.
Blocks of texts then get the code lengths of what occurs in them, and no worker ever holds the trie.

Next to it the base: a unigram model of lower-cased words with one added to every count, whose counts reach the
blocks in the same way.

Defined results: a null text is empty (an end alone); without training texts all symbols are equally likely and
no word is known; repeated rows are counted and scored each (``docs`` is read once, and counts and scores come from
the same stored blocks); a null doc_id counts as the empty text in the split.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm import text as tx
from terraloom.llm.blocks import BLOCK_BYTES, packed, row_slices, unpacked
from terraloom.session import cut_lineage, discard, shuffles_released

ORDER = 5
#: Bytes that UTF-8 never uses stand for the end and for what precedes a text.
END, BEFORE = 0xFE, 0xFF
#: Symbols that can be coded: all bytes but ``BEFORE``.
SYMBOLS = 255
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER_BYTES = np.frombuffer(LOWER, dtype=np.uint8)
#: The word that stands for a text's end.
END_WORD = b""
#: Findings that a task puts together before it sends them to their blocks.
PARCEL_ROWS = 1 << 20
#: Grams of a block's pieces that are held before they are summed, and bytes of text whose words are split at once.
HELD_GRAMS, WORD_SLICE = 1 << 20, 2 << 20


class ContextTrie:
    """The same model in one process: trained on texts, or adaptive within one."""

    def __init__(self, order: int = ORDER):
        self._order = order
        self._counts: dict[bytes, Counter] = {}

    def learn(self, text: bytes) -> None:
        line = bytes([BEFORE]) * self._order + text + bytes([END])
        for i in range(self._order, len(line)):
            self._add(line[i - self._order : i], line[i])

    def _add(self, context: bytes, symbol: int) -> None:
        for k in range(self._order + 1):
            self._counts.setdefault(context[k:], Counter())[symbol] += 1

    def log10_of(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for k in range(self._order + 1):
            counts = self._counts.get(context[k:])
            left = {s: c for s, c in counts.items() if s not in excluded} if counts else {}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / total)
            out += math.log10(len(left) / total)
            excluded |= left.keys()
        return out - math.log10(SYMBOLS - len(excluded))

    def score(self, text: bytes, adaptive: bool = False) -> float:
        """The log10 probability of a text; ``adaptive``: each symbol is learnt once it is coded."""
        line, out = bytes([BEFORE]) * self._order + text + bytes([END]), 0.0
        for i in range(self._order, len(line)):
            context = line[i - self._order : i]
            out += self.log10_of(context, line[i])
            if adaptive:
                self._add(context, line[i])
        return out


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id`` and the ``score`` of every text by a model that starts empty and learns from the text itself."""

    @F.arrow_udf(returnType="double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([ContextTrie(order).score((t or "").encode(), adaptive=True) for t in column.to_pylist()], pa.float64())

    return docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))


def _grams(offsets: np.ndarray, data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every (context, symbol) of a piece of texts; the symbol is the code's lowest byte."""
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    first = offsets[:-1] + np.arange(rows) * (order + 1)
    last = first + lengths + order
    inner = np.ones(len(data) + rows * (order + 1) + 8, dtype=bool)
    inner[-8:] = False
    inner[last] = False
    for k in range(order):
        inner[first + k] = False
    line = np.full(len(inner), BEFORE, dtype=np.uint8)
    line[inner] = data
    line[last] = END
    # Every eight bytes as one number, most significant first; a text's first grams begin in what precedes it.
    code = np.ndarray((len(line) - 8,), dtype=">u8", buffer=line, strides=(1,)).astype(np.uint64)
    code >>= np.uint64(8 * (7 - order))
    whole = np.ones(len(code), dtype=bool)
    for k in range(order):
        whole[first + lengths + 1 + k] = False
    return np.repeat(np.arange(rows, dtype=np.int32), lengths + 1), code.view(np.int64)[whole]


def _summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct codes and the sums of their counts, or how often each occurs."""
    if counts is None:
        codes = np.sort(codes)
    else:
        by_code = np.argsort(codes, kind="stable")
        codes, counts = codes[by_code], counts[by_code]
    starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    if counts is None:
        return codes[starts], np.diff(starts, append=len(codes))
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and lower-cased word of every word of a column; the row's end is not among them."""
    offsets, data = tx.buffers(texts)
    lowered = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_LOWER_BYTES[data].tobytes()))
    split = pc.ascii_split_whitespace(lowered)
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    filled = pc.not_equal(flat, "")  # white space at an end leaves an empty part
    return row[filled.to_numpy(zero_copy_only=False)], flat.filter(filled).dictionary_encode()


def _count_block(table: pa.Table, block: int, order: int) -> pa.RecordBatch:
    """What occurs in a block: every gram and word with its count in training texts (0: only in others)."""
    train = table.column("train").to_numpy().astype(bool)
    codes, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for base, piece in row_slices(table):
        row, code = _grams(*tx.buffers(piece.column("text")), order)
        learnt = train[base : base + piece.num_rows][row]
        for weight, own in ((1, code[learnt]), (0, code[~learnt])):
            distinct, times = _summed(own)
            codes.append(distinct)
            counts.append(times * weight)
            held += len(distinct)
        if held >= HELD_GRAMS:
            codes, counts, held = *([part] for part in _summed(np.concatenate(codes), np.concatenate(counts))), 0
    grams, gram_counts = _summed(np.concatenate(codes), np.concatenate(counts))
    del codes, counts
    words, word_counts = _counted_words(table, train)
    n, m = len(grams), len(words) + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + m, block), pa.int64()),
            pa.concat_arrays([pa.array(grams, pa.int64()), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), words.cast(pa.binary()), pa.array([END_WORD], pa.binary())]),
            pa.array(np.concatenate((gram_counts, word_counts, [train.sum()])), pa.int64()),
        ],
        names=["block", "gram", "word", "count"],
    )


def _counted_words(table: pa.Table, train: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a block and how often each occurs in its training texts."""
    kinds, times = [pa.array([], pa.string())], [np.zeros(0)]
    for base, piece in row_slices(table, WORD_SLICE):
        row, words = _words(piece.column("text"))
        kinds.append(words.dictionary)
        times.append(np.bincount(words.indices.to_numpy(), weights=train[base : base + piece.num_rows][row], minlength=len(words.dictionary)))
    together = pa.concat_arrays(kinds).dictionary_encode()
    sums = np.bincount(together.indices.to_numpy(), weights=np.concatenate(times), minlength=len(together.dictionary))
    return together.dictionary, sums.astype(np.int64)


def _suffix(gram: str, order: int) -> Column:
    """A gram of a shorter context: the lowest ``order + 1`` bytes."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def code_lengths(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram`` and ``log10`` probability of its symbol in its context; ``counted``: distinct grams with training counts, 0 included."""
    tables = {order: counted.filter("count > 0").select("gram", "count")}
    for k in range(order - 1, -1, -1):
        tables[k] = cut_lineage(tables[k + 1].groupBy(_suffix("gram", k).alias("gram")).agg(F.sum("count").alias("count")))
    contexts = {}
    for k, grams in tables.items():
        # below: the mass that this context's symbols have in the context one byte shorter
        below = tables[k - 1].select(F.col("gram").alias("short"), F.col("count").alias("below")) if k else None
        joined = grams.join(below, _suffix("gram", k - 1) == F.col("short")) if k else grams.withColumn("below", F.lit(0).cast("long"))
        stats = joined.groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("count").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("below").alias("below")
        )
        contexts[k] = cut_lineage(stats)
    full = contexts[order]
    seen = tables[order].join(full, F.shiftright("gram", 8) == F.col("context"))
    seen = seen.select("gram", F.log10(F.col("count") / (F.col("n") + F.col("d"))).alias("log10"))
    out = cut_lineage(seen.union(_escaped(counted.filter("count = 0").select("gram"), tables, contexts, order)))
    discard(*(tables[k] for k in range(order)), *contexts.values())
    return out


def _escaped(unseen: DataFrame, tables: dict[int, DataFrame], contexts: dict[int, DataFrame], order: int) -> DataFrame:
    """Code lengths of grams without a count: down the orders until one knows the symbol."""
    state = unseen.select("gram", F.lit(0.0).alias("log10"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("out_n"), F.lit(0).cast("long").alias("out_d"))
    for k in range(order, -1, -1):
        known = contexts[k].select(F.col("context"), "n", "d", "below")
        state = state.join(known, F.shiftright(_suffix("gram", k), 8) == F.col("context"), "left")
        if k < order:
            counts = tables[k].select(F.col("gram").alias("short"), "count")
            state = state.join(counts, _suffix("gram", k) == F.col("short"), "left")
        else:
            state = state.withColumn("count", F.lit(None).cast("long"))
        n, d = F.col("n") - F.col("out_n"), F.col("d") - F.col("out_d")
        here = F.when(F.col("done") | F.col("n").isNull() | (d <= 0), F.lit(0.0)).otherwise(F.log10(F.coalesce(F.col("count"), d) / (n + d)))
        state = state.select(
            "gram",
            (F.col("log10") + here).alias("log10"),
            (F.col("done") | F.col("count").isNotNull()).alias("done"),
            F.coalesce("below", F.lit(0)).cast("long").alias("out_n"),
            F.coalesce("d", F.lit(0)).cast("long").alias("out_d"),
        )
    rest = F.when(F.col("done"), F.lit(0.0)).otherwise(-F.log10(SYMBOLS - F.col("out_d")))
    return state.select("gram", (F.col("log10") + rest).alias("log10"))


def scored(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document ``score`` (log10 probability of the whole text), and of the base: ``n_tokens``, ``n_known``,
    ``train_tokens`` and ``base_score``; ``train`` says which rows are learnt from."""
    with shuffles_released(docs.sparkSession):
        found, sizes = _found(docs, train, order, block_bytes)
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("kinds") + 1)
    return found.join(F.broadcast(sizes)).select("doc_id", "train", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def _found(docs: DataFrame, train: Column, order: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """What :func:`scored` finds of each document, and the one row of ``kinds`` and ``train_tokens`` of the corpus."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    # Written once: a second scan of docs may be split otherwise, and its blocks would not fit the counts.
    texts = cut_lineage(packed(rows, block_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, content in zip(batch.column("block").to_pylist(), batch.column("content"), strict=True):
                yield _count_block(unpacked(content.as_buffer()), block, order)
                tx.release_memory()

    counted = cut_lineage(texts.mapInArrow(count, "block long, gram long, word binary, count long"), compression="zstd")
    grams, words = counted.filter("gram is not null").drop("word"), counted.filter("word is not null").drop("gram")
    distinct = cut_lineage(grams.groupBy("gram").agg(F.sum("count").alias("count")))
    lengths = code_lengths(distinct, order)
    discard(distinct)
    of_grams = grams.select("block", "gram").join(lengths, "gram").select("block", "gram", "log10").mapInArrow(_parcels(_parcel), "block long, parcel binary")
    # A word has one row per block at most. The first block that has a known word counts it.
    same = Window.partitionBy("word")
    total = F.sum("count").over(same)
    of_words = words.select("block", "word", total.alias("total"), ((F.min("block").over(same) == F.col("block")) & (total > 0)).alias("fresh"))
    of_words = of_words.mapInArrow(_parcels(_word_parcel), "block long, parcel binary")
    findings = of_grams.withColumn("of_words", F.lit(False)).union(of_words.withColumn("of_words", F.lit(True)))
    # Written before they meet the texts, so that the join's shuffle and all counts are gone by then.
    parcels = cut_lineage(findings)
    tokens = cut_lineage(words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("train_tokens")))
    discard(lengths, counted)
    schema = "doc_id long, train boolean, n_tokens long, n_known long, log_counts double, score double, fresh long"
    found = texts.groupBy("block").cogroup(parcels.groupBy("block")).applyInArrow(lambda key, left, right: _score_block(left, right, order), schema)
    found = cut_lineage(found)
    discard(texts, parcels)
    sizes = cut_lineage(found.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("kinds")).join(tokens))
    discard(tokens)
    return found, sizes


def _parcels(pack: Callable[[pa.Table], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows with a ``block`` each block's rows together, as bytes by ``pack``."""

    def parcelled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.take(np.argsort(table.column("block").to_numpy(), kind="stable")).combine_chunks()
        block = table.column("block").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
        parcels = [pack(table.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int64()), pa.array(parcels, pa.binary())], names=["block", "parcel"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PARCEL_ROWS:
                yield parcelled(held)
                held, rows = [], 0
                tx.release_memory()
        if rows:
            yield parcelled(held)
            tx.release_memory()

    return run


def _parcel(table: pa.Table) -> bytes:
    """Ascending grams as differences and code lengths by their kinds; like bytes stand together, which compresses well."""
    gram, value = table.column("gram").to_numpy(), table.column("log10").to_numpy()
    by_code = np.argsort(gram)
    gram, value = gram[by_code], value[by_code]
    which, kinds = pd.factorize(value)
    steps = np.diff(gram, prepend=0).view(np.uint8).reshape(-1, 8).T
    places = which.astype(np.int32).view(np.uint8).reshape(-1, 4).T
    return len(gram).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(steps.tobytes() + places.tobytes() + kinds.tobytes())


def _opened(parcel: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The grams and values of a :func:`_parcel`."""
    n, content = int.from_bytes(parcel[:8], "little"), zstandard.ZstdDecompressor().decompress(parcel[8:])
    steps = np.frombuffer(content, np.uint8, 8 * n).reshape(8, n).T.copy().view(np.int64)
    which = np.frombuffer(content, np.uint8, 4 * n, 8 * n).reshape(4, n).T.copy().view(np.int32)
    return np.cumsum(steps.reshape(-1)), np.frombuffer(content, np.float64, offset=12 * n)[which.reshape(-1)]


def _word_parcel(table: pa.Table) -> bytes:
    """Words with their totals, and whether the block is to count them."""
    sink = pa.BufferOutputStream()
    own = table.select(["word", "total", "fresh"]).combine_chunks()
    with pa.ipc.new_stream(sink, own.schema) as writer:
        writer.write_table(own)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _opened_words(parcel: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(parcel)) as reader:
        return reader.read_all()


def _score_block(texts: pa.Table, findings: pa.Table, order: int) -> pa.Table:
    table = unpacked(texts.column("content")[0].as_py())
    own = list(zip(findings.column("parcel").to_pylist(), findings.column("of_words").to_pylist(), strict=True))
    of_words = pa.concat_tables([_opened_words(p) for p, words in own if words])
    parcels = [_opened(p) for p, words in own if not words]
    codes, values = (np.concatenate(x) for x in zip(*parcels, strict=True)) if parcels else (np.zeros(0, np.int64), np.zeros(0))
    del parcels, own
    by_code = np.argsort(codes)
    codes, values = codes[by_code], values[by_code]
    score = [np.zeros(0)]
    for _, piece in row_slices(table):
        row, code = _grams(*tx.buffers(piece.column("text")), order)
        which, distinct = pd.factorize(code)
        at = np.minimum(np.searchsorted(codes, distinct), max(0, len(codes) - 1))
        if not len(codes) or not np.array_equal(codes[at], distinct):
            raise ValueError("a block's findings do not fit its texts")
        score.append(np.bincount(row, weights=values[at][which], minlength=piece.num_rows))
    known = pa.concat_arrays(of_words.column("word").chunks)
    logs = np.log10(of_words.column("total").to_numpy() + 1.0)
    end = float(logs[pc.index_in(pa.array([END_WORD], pa.binary()), value_set=known)[0].as_py()])
    tokens, knowns, log_counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for _, piece in row_slices(table, WORD_SLICE):
        row, words = _words(piece.column("text"))
        at = pc.index_in(words.dictionary.cast(pa.binary()), value_set=known).to_numpy(zero_copy_only=False)
        own = logs[at.astype(np.int64)][words.indices.to_numpy()] if len(row) else np.zeros(0)
        tokens.append(np.bincount(row, minlength=piece.num_rows) + 1)
        knowns.append(np.bincount(row[own > 0], minlength=piece.num_rows) + int(end > 0))
        log_counts.append(np.bincount(row, weights=own, minlength=piece.num_rows) + end)
    rows = table.num_rows
    once = np.zeros(rows, dtype=np.int64)
    once[:1] = int(np.sum(of_words.column("fresh").to_numpy()))
    return pa.Table.from_arrays(
        [
            table.column("doc_id").cast(pa.int64()),
            table.column("train"),
            pa.array(np.concatenate(tokens), pa.int64()),
            pa.array(np.concatenate(knowns), pa.int64()),
            pa.array(np.concatenate(log_counts), pa.float64()),
            pa.array(np.concatenate(score), pa.float64()),
            pa.array(once, pa.int64()),
        ],
        names=["doc_id", "train", "n_tokens", "n_known", "log_counts", "score", "fresh"],
    )
