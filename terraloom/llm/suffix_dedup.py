"""Removal of repeated long strings by external induced sorting of suffixes.

A byte goes if it lies in a string of ``MATCH`` bytes that also starts earlier, in a smaller doc_id or earlier in
the same text. Only the order of suffixes by their first ``MATCH`` bytes matters, and of it only where suffixes
agree and which of them comes first.

1. *Sampled suffixes.* As induced sorting samples suffixes at local minima, a suffix is sampled where the hash of
   its first ``GRAM`` bytes is the least within a window, so that every string of ``MATCH`` bytes covers a sample
   whose place in it follows from its content alone. About one suffix in thirty-five is sampled.
2. *Sorting the sample.* A tuple of a sample has the key of its gram, the key of all bytes that its windows cover,
   and its place. Spark's external sorter is the priority queue: tuples are dealt by gram, sorted on disk, and
   scanned once. Equal coverage: the earlier one stays, the others' windows go. No other tuple of that gram: done.
3. *Induction.* What is left, where common prefixes end between the samples, is sorted again in shorter steps:
   first as pieces of ``PIECE`` windows (the key is the prefix common to all of a piece's windows), then as single
   windows. Each step keeps only tuples that share their common prefix with another one.

Findings return to the texts by block; the blocks are written once, so that they are the same in every step. No step
holds more than a block of texts or a batch of tuples; texts are compared by 64-bit hashes of the bytes.

Defined results: a null text has no bytes; shorter texts than ``MATCH`` lose nothing; a null doc_id precedes all
others; of rows with equal ids the one read first precedes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm import text as tx
from terraloom.llm.blocks import BLOCK_BYTES, ids, packed, row_slices, unpacked
from terraloom.session import cut_lineage

MATCH = 100
GRAM = 32
PIECE = 16
#: Windows from whose start a sample is looked for.
REACH = MATCH - GRAM + 1

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)
TUPLE = "block long, outer long, inner long, doc_id long, place long, span int, lead int"
FINDING = "block long, place long, span int, lead int"
_ORDER = ("outer", "inner", "doc_id", "block", "place")
#: ``lead`` of a finding: this stretch of windows is to be removed. Others: bytes from the first window to the sample.
REMOVED = -1


def sampled(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """The samples of a piece of texts: row, first window (``at``, in the text), windows, lead, and keys of gram and coverage."""
    n = len(data)
    if n < MATCH:
        return {k: np.zeros(0, np.int64) for k in ("row", "at", "span", "lead")} | {k: np.zeros(0, np.uint64) for k in ("outer", "inner")}
    hashed = tx.SpanHash(data)
    place = np.arange(n - GRAM + 1)
    gram = hashed(place, place + GRAM)
    # Half of the hash and the place below it: the leftmost of equal ones is the least.
    low = np.uint64(32)
    least = (gram >> low << low) | place.astype(np.uint64)
    reached = 1
    while reached * 2 <= REACH:
        least = np.minimum(least[:-reached], least[reached:])
        reached *= 2
    if REACH > reached:
        least = np.minimum(least[: reached - REACH], least[REACH - reached :])
    sample = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    window = np.arange(len(sample))
    row = np.searchsorted(offsets, window, side="right") - 1
    whole = window + MATCH <= offsets[row + 1]
    window, sample, row = window[whole], sample[whole], row[whole]
    fresh = np.ones(len(window), dtype=bool)
    fresh[1:] = (sample[1:] != sample[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(fresh)
    span = np.diff(np.append(first, len(window)))
    start, row, sample = window[first], row[first], sample[first]
    lead = sample - start
    inner = tx.mix(hashed(start, start + span + (MATCH - 1)) + lead.astype(np.uint64) * _K1 + span.astype(np.uint64) * _K2)
    return {"row": row, "at": start - offsets[row], "span": span, "lead": lead, "outer": gram[sample], "inner": inner}


def _joined(place: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of windows that meet, as one each; places ascend and are of one text where they meet."""
    if not len(place):
        return place, span
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = place[1:] != place[:-1] + span[:-1]
    first = np.flatnonzero(fresh)
    return place[first], np.add.reduceat(span, first)


def _table(schema: str, **columns) -> pa.Table:
    """Columns of the schema from arrays or single values; 0 where none is given."""
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [c.split() for c in schema.split(", ")]
    n = len(columns["place"])
    arrays = []
    for name, kind in fields:
        value = columns.get(name, 0)
        if isinstance(value, np.ndarray) and value.dtype == np.uint64:
            value = value.view(np.int64)
        arrays.append(pa.array(np.broadcast_to(value, n), kinds[kind]))
    return pa.Table.from_arrays(arrays, names=[name for name, _ in fields])


def _carried(schema: str, block: int, place: np.ndarray, span: np.ndarray) -> pa.Table:
    """Findings on their way through a sort, dealt evenly."""
    return _table(schema, block=block, outer=tx.mix(place.view(np.uint64)), place=place, span=span, lead=REMOVED)


def _sample_tuples(group: pa.Table) -> pa.Table:
    """Step 1 for a block: its sample's first tuples of each coverage; the windows of later ones go at once."""
    block, table = group.column("block")[0].as_py(), unpacked(group.column("content")[0].as_py())
    parts = []
    for base, piece in row_slices(table):
        found = sampled(*tx.buffers(piece.column("text")))
        found["place"] = ((found.pop("row") + base) << 32) | found.pop("at")
        found["span"], found["lead"] = found["span"].astype(np.int32), found["lead"].astype(np.int32)
        parts.append(found)
    if not parts:
        return _table(TUPLE, place=np.zeros(0, np.int64))
    found = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    _, first = np.unique(tx.mix(found["inner"]) ^ found["outer"], return_index=True)
    first.sort()  # in the order of the texts, tuples pack closer
    again = np.ones(len(found["place"]), dtype=bool)
    again[first] = False
    gone = _joined(found["place"][again], found["span"][again])
    kept = {k: v[first] for k, v in found.items()}
    own = _table(TUPLE, block=block, doc_id=ids(table)[kept["place"] >> 32], **kept)
    return pa.concat_tables([own, _carried(TUPLE, block, *gone)])


def _sorted_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, str]]:
    """Parts of batches sorted by outer and inner key: ``carried`` findings, ``later`` tuples of an inner key, and
    ``shared`` ones, the first of their inner key whose outer key has several. One tuple at most waits for the next batch."""
    waiting, last = None, None
    for batch in batches:
        lead = batch.column("lead").to_numpy()
        if (lead == REMOVED).any():
            yield batch.filter(pa.array(lead == REMOVED)), "carried"
            batch = batch.filter(pa.array(lead != REMOVED))
        if not batch.num_rows:
            continue
        outer, inner = batch.column("outer").to_numpy(), batch.column("inner").to_numpy()
        before = np.concatenate(([last[0] if last else ~outer[0]], outer[:-1]))
        before_inner = np.concatenate(([last[1] if last else 0], inner[:-1]))
        later = (outer == before) & (inner == before_inner)
        first = np.flatnonzero(~later)
        if later.any():
            yield batch.filter(pa.array(later)), "later"
        if len(first):
            key = outer[first]
            same = key == before[first]
            if waiting is not None and same[0]:
                yield waiting, "shared"
            shared = same.copy()
            shared[:-1] |= key[1:] == key[:-1]
            if shared.any():
                yield batch.take(pa.array(first[shared])), "shared"
            waiting = None if shared[-1] else batch.slice(int(first[-1]), 1)
        last = (outer[-1], inner[-1])


def _findings(part: pa.RecordBatch, lead: int | None) -> pa.RecordBatch:
    columns = [part.column(c) for c in ("block", "place", "span")]
    leads = part.column("lead") if lead is None else pa.array(np.full(part.num_rows, lead), pa.int32())
    return pa.RecordBatch.from_arrays([*columns, leads], names=["block", "place", "span", "lead"])


def _scan_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: later tuples' windows go; those with another coverage beside them come back for induction."""
    for part, kind in _sorted_scan(batches):
        yield _findings(part, None if kind == "shared" else REMOVED)


def _induced(texts: pa.Table, findings: pa.Table, step) -> pa.Table:
    """Step 3 for a block: what is open as tuples of a shorter ``step``; findings so far are carried on."""
    if not texts.num_rows or not findings.num_rows:
        return _table(TUPLE, place=np.zeros(0, np.int64))
    block, table = texts.column("block")[0].as_py(), unpacked(texts.column("content")[0].as_py())
    place, span, lead = (findings.column(c).to_numpy() for c in ("place", "span", "lead"))
    order = np.argsort(place, kind="stable")
    place, span, lead = place[order], span[order].astype(np.int64), lead[order].astype(np.int64)
    gone = lead == REMOVED
    out = [_carried(TUPLE, block, *_joined(place[gone], span[gone]))]
    place, span, lead = place[~gone], span[~gone], lead[~gone]
    row, doc_ids = place >> 32, ids(table)
    wanted = np.unique(row)
    at = 0
    for _, piece in row_slices(table.select(["text"]).take(wanted).combine_chunks()) if len(wanted) else ():
        rows = wanted[at : at + piece.num_rows]
        at += piece.num_rows
        offsets, data = tx.buffers(piece.column(0))
        mine = slice(*np.searchsorted(row, [rows[0], rows[-1] + 1]))
        base = offsets[np.searchsorted(rows, row[mine])]
        # One entry per window: its start in the text's row and in the data, and the bytes to its sample.
        k = np.arange(span[mine].sum()) - np.repeat(np.cumsum(span[mine]) - span[mine], span[mine])
        places, leads = np.repeat(place[mine], span[mine]) + k, np.repeat(lead[mine], span[mine]) - k
        tuples = step(data, np.repeat(base, span[mine]) + (places & 0xFFFFFFFF), places, leads, k == 0)
        out.append(_table(TUPLE, block=block, doc_id=doc_ids[tuples["place"] >> 32], **tuples))
    return pa.concat_tables(out)


def _common(hashed: tx.SpanHash, start: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Key of the bytes that all windows of a window's piece have in common."""
    left = lead // PIECE * PIECE
    begin = start + lead - left
    return tx.mix(hashed(begin, begin + (MATCH - PIECE + 1)) + left.astype(np.uint64) * _K3)


def _as_pieces(data: np.ndarray, start: np.ndarray, place: np.ndarray, lead: np.ndarray, fresh: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of windows, by their common prefix and by all bytes that their windows cover."""
    number = lead // PIECE
    first = np.flatnonzero(fresh | (number != np.concatenate(([0], number[:-1]))))
    span = np.diff(np.append(first, len(place)))
    start, place, lead = start[first], place[first], lead[first]
    hashed = tx.SpanHash(data)
    inner = tx.mix(hashed(start, start + span + (MATCH - 1)) + lead.astype(np.uint64) * _K1 + span.astype(np.uint64) * _K2)
    return {"place": place, "span": span, "lead": lead, "outer": _common(hashed, start, lead), "inner": inner}


def _as_windows(data: np.ndarray, start: np.ndarray, place: np.ndarray, lead: np.ndarray, fresh: np.ndarray) -> dict[str, np.ndarray]:
    """Single windows, by the common prefix of their piece and by their own bytes."""
    inner = tx.SpanHash(data, 1)(start, start + MATCH)
    return {"place": place, "span": np.ones(len(place), np.int64), "lead": lead, "outer": _common(tx.SpanHash(data), start, lead), "inner": inner}


def _scan_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, kind in _sorted_scan(batches):
        if kind != "shared":
            yield _findings(part, REMOVED)


def _removals(texts: pa.Table, findings: pa.Table, names: list[str], as_text: bool) -> pa.Table:
    """Every row of a block with the bytes that are kept, or the text that they hold, and the removed spans."""
    table = unpacked(texts.column("content")[0].as_py())
    place, span = findings.column("place").to_numpy(), findings.column("span").to_numpy()
    order = np.argsort(place)
    place, span = place[order], span[order]
    row, start = place >> 32, place & 0xFFFFFFFF
    end = start + span + (MATCH - 1)
    cuts = np.searchsorted(row, np.arange(table.num_rows + 1))
    kept, spans = [], []
    null = table.column("text").is_null().to_pylist()
    for _, piece in row_slices(table.select(["text"])):
        offsets, data = tx.buffers(piece.column(0))
        for k in range(piece.num_rows):
            own = data[offsets[k] : offsets[k + 1]]
            mine = slice(cuts[len(kept)], cuts[len(kept) + 1])
            if mine.start == mine.stop:
                kept.append(None if null[len(kept)] else own.tobytes())
                spans.append([])
                continue
            starts, ends = start[mine], np.maximum.accumulate(end[mine])
            fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
            first = np.flatnonzero(fresh)
            a, b = starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)]
            edges = np.concatenate(([0], np.column_stack((a, b)).reshape(-1), [len(own)]))
            kept.append(b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            spans.append(edges[1:-1].tolist())
    left = pa.array([None if k is None else k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    result = table.select(names)
    return result.append_column("kept", left).append_column("spans", pa.array(spans, pa.list_(pa.int32())))


def deduplicated(docs: DataFrame, block_bytes: int = BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but ``text``, with the ``kept`` bytes (null for a null text) and the removed ``spans``
    of bytes (flat pairs); they may not have these two names. ``as_text``: what is kept as a string, in which a
    character that loses bytes goes whole."""
    names = [c for c in docs.columns if c != "text"]
    texts = cut_lineage(packed(docs.withColumn("text", F.col("text").cast("string")), block_bytes))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_order(tuples: DataFrame, *dealt_by: str) -> DataFrame:
        return tuples.repartition(parts, *dealt_by).sortWithinPartitions(*_ORDER)

    def with_texts(findings: DataFrame, work, schema: str) -> DataFrame:
        return texts.groupBy("block").cogroup(findings.groupBy("block")).applyInArrow(lambda _, left, right: work(left, right), schema)

    samples = texts.groupBy("block").applyInArrow(_sample_tuples, TUPLE)
    findings = in_order(samples, "outer").mapInArrow(_scan_open, FINDING)
    pieces = with_texts(findings, lambda left, right: _induced(left, right, _as_pieces), TUPLE)
    findings = in_order(pieces, "outer").mapInArrow(_scan_open, FINDING)
    windows = with_texts(findings, lambda left, right: _induced(left, right, _as_windows), TUPLE)
    found = in_order(windows, "outer", "inner").mapInArrow(_scan_windows, FINDING)
    kinds = [T.StructField(n, docs.schema[n].dataType) for n in names]
    schema = T.StructType([*kinds, T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("spans", T.ArrayType(T.IntegerType()))])
    return with_texts(found, lambda left, right: _removals(left, right, names, as_text), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and its length in ``n_chars`` if there is such a column; no row goes.

    A null text stays null.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    left = deduplicated(docs.select("doc_id", "text", row), as_text=True)
    own = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
