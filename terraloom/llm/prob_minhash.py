"""Near duplicates by ProbMinHash, banding and verification.

Every shingle of a text starts a Poisson process of its weight; each arrival falls on one of ``REGISTERS``
registers, which keeps the shingle of its first arrival. Two texts agree in a register with the probability
Jaccard similarity of their weighted shingles, which for equal weights is the Jaccard similarity of the sets.
Arrivals after the last register's first one cannot matter, so the processes stop there.

Texts that agree in a band of registers are candidates. In every bucket all texts are first compared with its
least one, over whole shingle sets, and linked texts form classes. Then, among the texts that were compared with
the same one, those of different classes are compared with each other, in pairs of blocks of ``BLOCK_TEXTS``: so
every pair of a bucket is compared or already in one class, yet no pair is a row.

Shingles are five words, words are runs without white space; a text of one to four words is one shingle.
Defined results: equal texts are one class, also wordless ones; a null text is a class of its own; a null doc_id
takes the class of an equal text or none; repeated rows each get their class; of rows with equal doc_ids and different
texts each has the class of its text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm import text as tx
from terraloom.llm.graph import components
from terraloom.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Bands and registers per band: a pair of similarity 0.8 is missed with probability 5e-5, one of 0.85 with 1e-6.
BANDS, BAND_REGISTERS = 25, 5
REGISTERS = BANDS * BAND_REGISTERS
#: Texts in a block of comparisons, and shingles in one step of it.
BLOCK_TEXTS = 256
_COLUMNS = 4096

_ARRIVAL = np.uint64(0xA0761D6478BD642F)
_REGISTER = np.uint64(0xE7037ED1A0B428DB)
_ROW = np.uint64(0x9E3779B97F4A7C15)


def shingles(offsets: np.ndarray, data: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of occurrences of every distinct shingle, by row."""
    rows = len(offsets) - 1
    row, start, end = tx.words(offsets, data)
    word = tx.SoundSpanHash(data)(start, end)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    begin = np.flatnonzero(np.arange(len(row)) + size <= (first + count)[row]) if len(row) else np.zeros(0, np.int64)
    begin = np.concatenate((begin, first[(count > 0) & (count < size)]))
    length = np.minimum(count[row[begin]], size)
    key = word[begin]
    for step in range(1, size):
        more = length > step
        key[more] = tx.mix(key[more] * np.uint64(3) + word[begin[more] + step])
    place = row[begin]
    _, at, times = np.unique(tx.mix(key + place.astype(np.uint64) * _ROW), return_index=True, return_counts=True)
    order = np.argsort(place[at], kind="stable")
    at, times = at[order], times[order]
    return place[at], key[at], times


def registers(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first at each of ``m`` registers of each row; 0 in rows without shingles."""
    total = np.bincount(row, weights=weight, minlength=rows)
    horizon = np.where(total > 0, m * (math.log(m) + 4) / np.maximum(total, 1e-300), 0.0)
    arrived = np.full(rows * m, np.inf)
    taken = np.zeros(rows * m, dtype=np.uint64)
    waiting = total > 0
    while waiting.any():
        active = np.flatnonzero(waiting[row])
        time = np.zeros(len(active))
        limit, k = horizon.copy(), 0
        while len(active):
            draw = tx.mix(shingle[active] + np.uint64((k + 1) * int(_ARRIVAL) % 2**64))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active]
            soon = time <= limit[row[active]]
            active, time = active[soon], time[soon]
            slot = row[active] * m + (tx.mix(draw[soon] ^ _REGISTER) % np.uint64(m)).astype(np.int64)
            better = np.flatnonzero(time < arrived[slot])
            better = better[np.argsort(-time[better], kind="stable")]
            arrived[slot[better]] = time[better]
            taken[slot[better]] = shingle[active[better]]
            k += 1
            if k % 16 == 0:  # nothing after the last register's first arrival matters
                limit = np.minimum(limit, arrived.reshape(rows, m).max(axis=1))
        waiting &= np.isinf(arrived.reshape(rows, m).max(axis=1))
        horizon = horizon * 2
    return taken.reshape(rows, m)


def band_keys(taken: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = taken.reshape(len(taken), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _REGISTER, (len(taken), 1))
    for k in range(parts.shape[2]):
        key = tx.mix(key + parts[:, :, k])
    return key.view(np.int64)


def text_keys() -> list[Column]:
    """``k1`` and ``k2``: the first 128 bits of the digest of a whole text, null for a null text."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "k1"), (17, "k2"))]


def signed(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """``doc_id``, the text's keys (null for a null text), its number of shingles and its band keys."""

    @F.arrow_udf(returnType="n_shingles int, bands array<long>")
    def sign(column: pa.Array) -> pa.Array:
        def work(texts: pa.Array) -> list:
            offsets, data = tx.buffers(texts)
            rows = len(texts)
            row, shingle, times = shingles(offsets, data)
            taken = registers(row, shingle, times.astype(float) if weighted else np.ones(len(row)), rows)
            keys = pa.array(band_keys(taken).reshape(-1), pa.int64())
            return [
                pa.array(np.bincount(row, minlength=rows), pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), keys),
            ]

        return tx.row_wise(column, work, ["n_shingles", "bands"])

    texts = tx.bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", *text_keys(), sign("text").alias("_s")).select("doc_id", "k1", "k2", "_s.*")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """``id`` and ``shingles`` (sorted hashes, with counts if weighted) of the texts of ``wanted``: ``id, doc_id, k1, k2``."""

    @F.arrow_udf(returnType="shingles binary")
    def sets(column: pa.Array) -> pa.Array:
        def work(texts: pa.Array) -> list:
            offsets, data = tx.buffers(texts)
            row, shingle, times = shingles(offsets, data)
            order = np.lexsort((shingle, row))
            cuts = np.searchsorted(row[order], np.arange(len(texts) + 1))
            shingle, times = shingle[order], times[order].astype(np.uint64)
            packed = [
                np.concatenate((shingle[a:b], times[a:b])).tobytes() if weighted else shingle[a:b].tobytes()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            return [pa.array(packed, pa.binary())]

        return tx.row_wise(column, work, ["shingles"])

    keys = ["doc_id", "k1", "k2"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").select("*", *text_keys())
    # Repeated rows of one document are met once more here than once; one of them is as good as all.
    found = texts.join(wanted, keys).select("id", *keys, sets("text").alias("_s"))
    return found.groupBy("id", *keys).agg(F.any_value("_s.shingles").alias("shingles")).select("id", "shingles")


def similarity(a: bytes, b: bytes, weighted: bool) -> float:
    """Probability Jaccard similarity of two packed shingle sets; for equal weights the Jaccard similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not weighted:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared / max(1, len(x) + len(y) - shared)
    (hx, wx), (hy, wy) = ((v[: len(v) // 2], v[len(v) // 2 :].astype(float)) for v in (x, y))
    union = np.union1d(hx, hy)
    p, q = np.zeros(len(union)), np.zeros(len(union))
    p[np.searchsorted(union, hx)], q[np.searchsorted(union, hy)] = wx, wy
    both = (p > 0) & (q > 0)
    ratio = np.divide(p, q, out=np.full(len(union), np.inf), where=q > 0)
    order = np.argsort(ratio)
    below_q = np.concatenate(([0], np.cumsum(q[order])))
    above_p = np.concatenate((np.cumsum(p[order][::-1])[::-1], [0]))
    at = np.searchsorted(ratio[order], ratio[both])
    return float((1 / (above_p[at] / p[both] + below_q[at] / q[both])).sum())


def linked(pairs: DataFrame, sets: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """The pairs ``a, b`` of at least the threshold."""

    @F.arrow_udf(returnType="double")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([similarity(x.as_buffer(), y.as_buffer(), weighted) for x, y in zip(left, right, strict=True)], pa.float64())

    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    found = pairs.join(first, "a").join(second, "b")
    return found.filter(compare("left", "right") >= threshold).select("a", "b")


def _across(stars: DataFrame, found: DataFrame, sets: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Links ``a, b`` between texts of different components that were compared with the same text."""
    placed = stars.join(found.withColumnRenamed("id", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    mixed = placed.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")
    own = placed.join(mixed.filter("low < high").select("a", blocks.alias("blocks")), "a")
    own = own.withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    # Rounds of block pairs: every text goes to all pairs of its own block with another or itself.
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("a", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "b", "component")
    full = dealt.join(sets.select(F.col("id").alias("b"), "shingles"), "b")

    def compare(group: pa.Table) -> pa.Table:
        low = group.column("low")[0].as_py()
        left = group.filter(pa.compute.equal(group.column("block"), low))
        right = left if low == group.column("high")[0].as_py() else group.filter(pa.compute.not_equal(group.column("block"), low))
        links = _links_between(left, right, threshold, weighted)
        return pa.Table.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    linked_ids = full.groupBy("a", "low", "high").applyInArrow(compare, "a long, b long")
    return linked_ids.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links_between(left: pa.Table, right: pa.Table, threshold: float, weighted: bool) -> list[tuple[int, int]]:
    """Links between texts of different components; of a text's links to one component, the first suffices."""
    ids, component, packed = ([t.column(c).to_pylist() for t in (left, right)] for c in ("b", "component", "shingles"))
    if not ids[0] or not ids[1]:
        return []
    parts = [np.array(c) for c in component]
    apart = parts[0][:, None] != parts[1][None, :]
    if not apart.any():
        return []
    if weighted:
        close = np.array([[apart[i, j] and similarity(x, y, True) >= threshold for j, y in enumerate(packed[1])] for i, x in enumerate(packed[0])])
    else:
        shared, sizes = _shared_counts(*packed)
        close = apart & (shared >= threshold * (sizes[0][:, None] + sizes[1][None, :] - shared))
    links = {}
    for i, j in zip(*np.nonzero(close), strict=True):
        links.setdefault((int(i), parts[1][j]), (ids[0][i], ids[1][j]))
    return list(links.values())


def _shared_counts(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of shared shingles of every text on the left with every one on the right, and both sides' sizes."""
    sets = [[np.frombuffer(b, np.uint64) for b in side] for side in (left, right)]
    sizes = [np.array([len(x) for x in side]) for side in sets]
    values = [np.concatenate(side) for side in sets]
    rows = [np.repeat(np.arange(len(side)), n) for side, n in zip(sets, sizes, strict=True)]
    common = np.intersect1d(*values)
    at = [np.searchsorted(common, v) for v in values]
    for side in range(2):
        hit = np.isin(values[side], common)
        order = np.argsort(at[side][hit], kind="stable")
        at[side], rows[side] = at[side][hit][order], rows[side][hit][order]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, len(common), _COLUMNS):
        stop = min(start + _COLUMNS, len(common))
        planes = []
        for side, texts in enumerate((left, right)):
            a, b = np.searchsorted(at[side], [start, stop])
            plane = np.zeros((len(texts), stop - start), dtype=np.float32)
            plane[rows[side][a:b], at[side][a:b] - start] = 1
            planes.append(plane)
        shared += planes[0] @ planes[1].T
    return shared, sizes


def _named(docs: DataFrame, threshold: float, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """Every row's ``doc_id, k1, k2``, and every distinct text's keys with its least ``doc_id``, the least one of its
    class (``class_id``), and whether it stands for its class (``first``)."""
    rows = cut_lineage(signed(docs, weighted))
    texts = (
        rows.filter("k1 is not null and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    )
    # A number of its own for every text, as several texts may have one doc_id; written once, so that it stays.
    texts = cut_lineage(texts.withColumn("id", F.monotonically_increasing_id()))
    spread = texts.filter("n_shingles > 0").select("id", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(spread.join(buckets.drop("n"), "bucket"))
    wanted = members.select("id").distinct().join(texts.select("id", "doc_id", "k1", "k2"), "id")
    sets = cut_lineage(_shingle_sets(docs, wanted, weighted))
    stars = cut_lineage(members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    edges = cut_lineage(linked(stars, sets, threshold, weighted))
    found = cut_lineage(components(edges))
    more = cut_lineage(_across(stars, found, sets, threshold, weighted))
    if not more.isEmpty():
        found = cut_lineage(components(edges.union(more)))
    own = texts.select("k1", "k2", "doc_id", "id")
    linked_texts = own.join(found, "id")
    least = linked_texts.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("least"))
    own = own.join(cut_lineage(found.join(least, "component").select("id", "least")), "id", "left")
    return rows.select("doc_id", "k1", "k2"), own.select(
        "k1", "k2", "doc_id", F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce(F.col("least.id") == F.col("id"), F.lit(True)).alias("first")
    )


def classes(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """``doc_id``, ``text_id`` (least doc_id of an equal text) and ``class_id`` (least doc_id of the class) of every document."""
    rows, texts = _named(docs, threshold, weighted)
    named = texts.select("k1", "k2", F.col("doc_id").alias("text_id"), "class_id")
    return rows.join(named, ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("class_id", "doc_id").alias("class_id")
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class, with all their columns.

    What stays is the text that comes first in its class, by doc_id, under its least doc_id; of rows equal in doc_id
    and text one stays. A text that is in no class with others stays also if its doc_id is that of other texts. Rows
    without a doc_id cannot be told apart; all of them stay.
    """
    _, texts = _named(docs, threshold, weighted=False)
    first = cut_lineage(texts.filter("first").select("doc_id", "k1", "k2"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = docs.select(whole, "doc_id", F.col("text").cast("string").alias("text")).select("_row", "doc_id", *text_keys())
    named = keyed.join(first, ["doc_id", "k1", "k2"], "left_semi")
    nulls = keyed.filter("k1 is null and doc_id is not null")
    kept = named.unionByName(nulls).dropDuplicates(["doc_id", "k1", "k2"])
    return kept.unionByName(keyed.filter("doc_id is null")).select("_row.*")
