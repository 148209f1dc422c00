"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are cut into windows of words; all windows form one automaton, and every normalised text is
scanned once. Word numbers lead back to the original text.

The benchmark is the stated query set. Its windows make one automaton up to ``BLOCK_BYTES``; a larger benchmark is
dealt into blocks of that size, each an automaton that scans every batch, and a worker holds ``HELD`` of them.

Defined results: a null or wordless text has no words and is never contaminated; a wordless item has no
window; a null item id counts as the empty string; repeated items are one item.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.text import bounded, release_memory

WINDOW = 13
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20
#: Bytes of windows in one automaton, which takes about 40 times as much memory.
BLOCK_BYTES = 2 << 20
HELD = 3
FOUND = "n_words long, n_hit long, runs array<int>, items array<string>, spans array<int>"
#: Letters and digits stay, A-Z in lower case; other ASCII characters part words; all else is part of words.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return (text or "").encode().translate(FOLD).split()


def windows(benchmark: DataFrame) -> DataFrame:
    """``pattern`` (words between spaces) and ``item_id`` of every distinct window of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = normalised(text)
                for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                    found.add((b" " + b" ".join(w[i : i + WINDOW]) + b" ", item or ""))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["pattern", "item_id"]
            )

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, "pattern binary, item_id string").distinct()


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[dict[str, list[str]]]:
    """The windows in blocks of bounded size, one block on the driver at a time: pattern to item ids."""
    found = windows(benchmark)
    total = found.agg(F.sum(F.octet_length("pattern") + F.octet_length("item_id"))).first()[0] or 0
    count = total // block_bytes + 1
    dealt = found.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(count)))
    for k in range(count):
        patterns: dict[str, list[str]] = {}
        for row in dealt.filter(F.col("block") == k).toLocalIterator():
            patterns.setdefault(bytes(row.pattern).decode("latin-1"), []).append(row.item_id)
        yield patterns


class Scanner:
    """An automaton over one block of windows."""

    def __init__(self, patterns: dict[str, list[str]]):
        self._automaton = ahocorasick.Automaton()
        for pattern, items in patterns.items():
            self._automaton.add_word(pattern, (pattern.count(" ") - 1, items))
        self._automaton.make_automaton()
        self._empty = not patterns

    def find(self, line: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words ``[first, last + 1)``, as found, and the items whose windows occur in a :func:`line`."""
        matches = [] if self._empty else list(self._automaton.iter(line))
        if not matches:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        after = np.searchsorted(spaces, [end for end, _ in matches])
        runs = [(int(a) - n, int(a)) for a, (_, (n, _)) in zip(after, matches, strict=True)]
        return runs, {item for _, (_, items) in matches for item in items}


def line(words: list[bytes]) -> str:
    """Words between single spaces, one character per byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


_scanners: dict[tuple[str, int], Scanner] = {}


def _scanner(name: str, k: int, patterns) -> Scanner:
    """A block's automaton; a worker process holds ``HELD`` of them."""
    if (name, k) not in _scanners:
        while len(_scanners) >= HELD:
            _scanners.pop(next(iter(_scanners)))
        _scanners[name, k] = Scanner(patterns.value)
    return _scanners[name, k]


def found_in(text: Column, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Column:
    """What the benchmark's windows hit in ``text``: words, hit words, runs of hit words, items, spans of characters."""
    context = bounded(benchmark).sparkSession.sparkContext
    held = [context.broadcast(patterns) for patterns in blocks(benchmark, block_bytes)]
    name = uuid.uuid4().hex

    @F.arrow_udf(returnType=FOUND)
    def scan(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        n_words, lines = [], []
        for text in texts:
            words = normalised(text)
            n_words.append(len(words))
            lines.append(line(words))
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for k, patterns in enumerate(held):
            scanner = _scanner(name, k, patterns)
            for i, own in enumerate(lines):
                hit, names = scanner.find(own)
                runs[i] += hit
                items[i] |= names
        runs = [merged(r) for r in runs]
        ints = pa.list_(pa.int32())
        fields = [
            pa.array(n_words, pa.int64()),
            pa.array([sum(end - start for start, end in r) for r in runs], pa.int64()),
            pa.array([[x for run in r for x in run] for r in runs], ints),
            pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            pa.array([original_spans(t, r) if r else [] for t, r in zip(texts, runs, strict=True)], ints),
        ]
        del texts, lines
        release_memory()
        return pa.StructArray.from_arrays(fields, names=["n_words", "n_hit", "runs", "items", "spans"])

    return scan(text.cast("string"))


def judged(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document its words, hit words, the items and spans found, and whether it is contaminated."""
    found = docs.select("doc_id", found_in(F.col("text"), benchmark, block_bytes).alias("_found")).select("doc_id", "_found.*")
    return found.withColumn("contaminated", _contaminated("n_hit", "n_words"))


def _contaminated(n_hit: str, n_words: str) -> Column:
    return (F.col(n_hit) > 0) & (SHARE * F.col(n_hit) >= F.col(n_words))


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = docs.select(whole.alias("_doc"), found_in(F.col("text"), benchmark, block_bytes).alias("_found"))
    return found.filter(~_contaminated("_found.n_hit", "_found.n_words")).select("_doc.*")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[int]:
    """Characters ``[start, end)`` of the original text that the runs of words cover, flat."""
    places = [m.span() for m in WORD.finditer(text)]
    return [x for start, end in runs for x in (places[start][0], places[end - 1][1])]
