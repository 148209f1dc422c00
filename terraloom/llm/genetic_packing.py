"""Packing of documents into sequences by a grouping genetic algorithm on islands.

A document's ids are cut only if they do not fit into one sequence. Pieces that fill a sequence are one; the others are
dealt into groups of some thousands, and each group is packed on several islands at once. An individual is a whole
packing of the group. Crossover takes whole well-filled bins of one parent into the other, drops the bins that hold
duplicates of what came in, and puts the documents displaced by that back by best fit, largest first; mutation empties
a few badly filled bins in the same way. After each epoch every island sends its elite to the next one.

Each group's best packing is kept but for its worst filled bins, whose documents (an eighth of the group at most) are
dealt anew with those of other groups, until one group is left: so what a group could not fill is lost once, not once
a group, and every round has at most an eighth of the work of the one before. A task holds one group at a time; no
step sees all documents.

Defined results: a null or empty text has the end id alone; repeated rows are packed each; a null doc_id is packed as
any other; an empty table gives an empty result; other columns are not read. Numbers of sequences have gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.text import bounded, release_memory, slices
from terraloom.llm.token_files import ENCODE_BYTES, encoder
from terraloom.session import cut_lineage

CAPACITY = 2048
#: Documents in a group, islands a group, epochs between which elites migrate, generations in an epoch, packings on an island.
GROUP_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2, 2, 8, 4
#: Share of a group's documents, in its worst filled bins, that are dealt anew at most.
LEFT = 8
PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
_SEQUENCE_BITS = 20


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document's ids: its number, ``start`` (ids of its document before it), ``length`` and the
    digest of its ids. Only longer documents are cut; all pieces but the first are of full length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), np.array([end_id], dtype="<u4")
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, limit=ENCODE_BYTES):
                rows = []
                for name, coded in zip(part.column(0).to_pylist(), own.encode(part.column(1).fill_null("")), strict=True):
                    ids = np.concatenate((coded, end)).astype("<u4", copy=False)
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        rows.append((item, name, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes())))
                        item += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in PIECES.split(", ")])
        release_memory()

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(run, PIECES))


# One group: sizes of documents, and packings as the bin of each document.


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, rest: np.ndarray, capacity: int) -> None:
    """Puts the documents of ``order`` one after the other into the fullest bin that they fit in, or a new one.

    ``bins`` gets their bins; ``rest`` is the free space of the bins that exist, none in bins that are not to be used.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has r free
    for b in np.flatnonzero(rest > 0).tolist():
        stacks[rest[b]].append(b)
    for r, stack in enumerate(stacks):
        if stack:
            free |= 1 << r
    fresh = len(rest)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        above = free >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                free ^= 1 << r
        else:
            r, b = capacity, fresh
            fresh += 1
        bins[i] = b
        r -= size
        if r:
            if not stacks[r]:
                free |= 1 << r
            stacks[r].append(b)


def renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray) -> float:
    """Fewer bins first, then bins that are filled unevenly, as their free space is of more use in one place."""
    fill = np.bincount(bins, weights=sizes)
    return -len(fill) + float((fill**2).sum()) / max(1.0, float(fill.sum()) ** 2)


def descending(sizes: np.ndarray, items: np.ndarray, rng: np.random.Generator, noise: float = 0.0) -> np.ndarray:
    """Documents by falling size, equal ones in random order; ``noise`` shakes the order."""
    key = sizes[items] * (1 + noise * rng.random(len(items))) + rng.random(len(items)) * 0.5
    return items[np.argsort(-key, kind="stable")]


def crossover(sizes: np.ndarray, one: np.ndarray, two: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``one`` with some well-filled bins of ``two``: bins of ``one`` that share a document with them go, and what else
    was in those is put back by best fit."""
    fill_two = np.bincount(two, weights=sizes).astype(np.int64)
    chosen = (fill_two >= np.quantile(fill_two, 0.5)) & (rng.random(len(fill_two)) < rng.uniform(0.05, 0.4))
    injected = chosen[two]
    hit = np.zeros(int(one.max()) + 1, dtype=bool)
    hit[one[injected]] = True
    displaced = np.flatnonzero(hit[one] & ~injected)
    n = len(hit)
    out = np.where(injected, two + n, one).astype(np.int64)
    rest = np.zeros(n + len(fill_two), dtype=np.int64)
    kept = np.flatnonzero(~hit)
    rest[kept] = capacity - np.bincount(one, weights=sizes, minlength=n).astype(np.int64)[kept]
    rest[n + np.flatnonzero(chosen)] = capacity - fill_two[chosen]
    best_fit(sizes, descending(sizes, displaced, rng), out, rest, capacity)
    return renumbered(out)


def mutated(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties the worst filled bins and a few others, and puts their documents back."""
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    emptied = fill <= np.sort(fill)[min(len(fill) - 1, 2)]
    emptied |= rng.random(len(fill)) < 0.03
    out = bins.astype(np.int64)
    rest = np.where(emptied, 0, capacity - fill)
    best_fit(sizes, descending(sizes, np.flatnonzero(emptied[bins]), rng), out, rest, capacity)
    return renumbered(out)


def evolved(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, size: int, seed: int) -> list[np.ndarray]:
    """The island after some generations, best packing first; an empty one begins with best fits of shaken orders.

    A packing that fills all bins but one is as good as any; the island stops there.
    """
    rng = np.random.default_rng(seed)
    items = np.arange(len(sizes))
    least = -(-int(sizes.sum()) // capacity)

    def rated(bins: np.ndarray) -> tuple[float, np.ndarray]:
        return fitness(sizes, bins), bins

    island = [rated(p) for p in population]
    while len(island) < size and not any(len(np.unique(p)) <= least for _, p in island):
        bins = np.zeros(len(sizes), dtype=np.int64)
        best_fit(sizes, descending(sizes, items, rng, 0.0 if not island else 0.2 * len(island)), bins, np.zeros(0, np.int64), capacity)
        island.append(rated(renumbered(bins)))
    island.sort(key=lambda x: -x[0])
    for _ in range(generations):
        if int(island[0][1].max()) + 1 <= least:
            break
        for k in range(len(island)):
            other = island[int(rng.integers(len(island)))][1]
            child = crossover(sizes, island[k][1], other, capacity, rng) if other is not island[k][1] else mutated(sizes, other, capacity, rng)
            if rng.random() < 0.3:
                child = mutated(sizes, child, capacity, rng)
            own = rated(child)
            if own[0] > island[-1][0] and all(own[0] != f for f, _ in island):
                island[-1] = own
                island.sort(key=lambda x: -x[0])
    return [p for _, p in island[:size]]


# Rounds over all groups


_GROUP = "grp long, items binary, sizes binary"
_ISLAND = _GROUP + ", island int, population binary"


def _to_group(table: pa.Table) -> pa.Table:
    items, sizes = table.column("item").to_numpy(), table.column("length").to_numpy()
    order = np.argsort(items)
    columns = [table.column("grp").slice(0, 1), pa.array([items[order].tobytes()], pa.binary()), pa.array([sizes[order].astype(np.int32).tobytes()], pa.binary())]
    return pa.Table.from_arrays(columns, names=["grp", "items", "sizes"])


def _epoch(capacity: int, generations: int, population: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                before = [np.frombuffer(p, np.int32) for p in (row["population"], row.get("elite")) if p]
                before = [p for stack in before for p in stack.reshape(-1, len(sizes))]
                seed = zlib.crc32(f"{row['grp']} {row['island']} {number} {len(sizes)}".encode())
                packings = evolved(sizes, before, capacity, generations, population, seed)
                out.append((row["grp"], row["items"], row["sizes"], row["island"], np.concatenate(packings).tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _ISLAND.split(", ")])

    return run


def _elite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best packing of each island and how good it is."""
    for batch in batches:
        out = []
        for row in batch.select(["grp", "island", "sizes", "population"]).to_pylist():
            best = np.frombuffer(row["population"], np.int32)[: len(row["sizes"]) // 4]
            out.append((row["grp"], row["island"], best.tobytes(), fitness(np.frombuffer(row["sizes"], np.int32).astype(np.int64), best)))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["grp", "island", "elite", "fitness"])


_ELITE = "grp long, island int, elite binary, fitness double"


def _placed(capacity: int, base: int, final: bool):
    """Every document of a group's best packing with its sequence and place, or none if it is to be dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, sizes = np.frombuffer(row["items"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                bins = np.frombuffer(row["elite"], np.int32)
                order = np.argsort(bins, kind="stable")
                items, sizes, bins = items[order], sizes[order], bins[order]
                ends = np.cumsum(sizes)
                first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
                offset = ends - sizes - (ends - sizes)[first][bins]
                fill, count = np.bincount(bins, weights=sizes), np.bincount(bins)
                worst = np.argsort(fill, kind="stable")
                again = np.zeros(len(fill), dtype=bool)
                if not final:
                    again[worst[np.cumsum(count[worst]) <= len(items) // LEFT]] = True
                    again &= fill < capacity
                sequence = base + (row["grp"] << _SEQUENCE_BITS) + bins.astype(np.int64)
                columns = [
                    pa.array(items),
                    pa.array(sizes),
                    pa.array(sequence, mask=again[bins]),
                    pa.array(offset, pa.int64(), mask=again[bins]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "length", "sequence_id", "offset"])

    return run


def _round(left: DataFrame, number: int, groups: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """One packing of ``item, length``: all groups, islands and epochs."""
    dealt = left.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)))
    packed = cut_lineage(dealt.select("grp", "item", "length").groupBy("grp").applyInArrow(_to_group, _GROUP))
    state = bounded(packed).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("population", F.lit(None).cast("binary"))
    for epoch in range(epochs):
        if epoch:
            elites = state.select("grp", "island", "sizes", "population").mapInArrow(_elite, _ELITE)
            elites = elites.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "elite")
            state = state.join(elites, ["grp", "island"])
        state = cut_lineage(state.mapInArrow(_epoch(capacity, generations, population, epoch), _ISLAND))
    best = state.select("grp", "island", "sizes", "population").mapInArrow(_elite, _ELITE)
    best = best.groupBy("grp").agg(F.max_by("elite", F.struct("fitness", "island")).alias("elite"))
    base = (number + 1) << 56
    return cut_lineage(packed.join(best, "grp").mapInArrow(_placed(capacity, base, groups == 1), "item long, length long, sequence_id long, offset long"))


def placed(
    items: DataFrame,
    capacity: int = CAPACITY,
    group_items: int = GROUP_ITEMS,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
) -> DataFrame:
    """``item``, ``sequence_id`` and ``offset`` of all rows ``item`` (unique), ``length`` (1 to ``capacity``)."""
    full = items.filter(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, found, number = items.filter(F.col("length") < capacity).select("item", "length"), [full], 0
    while n := left.count():
        groups = -(-n // group_items)
        packed = _round(left, number, groups, capacity, islands, epochs, generations, population)
        found.append(packed.filter("sequence_id is not null").select("item", "sequence_id", "offset"))
        left, number = packed.filter("sequence_id is null").select("item", "length"), number + 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, **settings: int) -> DataFrame:
    """The pieces of every document with their sequence and their place in it."""
    own = pieces(docs, tokenizer, end_id, capacity)
    return own.join(placed(own, capacity, **settings), "item").drop("item")
