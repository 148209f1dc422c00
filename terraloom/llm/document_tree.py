"""Ranked lexical search by frequency-ordered trees of documents.

Of every text only the terms of the query items matter: its restricted vector of terms and their occurrences. Some
thousand vectors at a time become a tree as in frequent-pattern mining: terms in descending document frequency, so
that vectors share their paths from the root. A subtree knows for every term the largest number of occurrences and
the least length weight ``m`` of its documents, so that its best possible score for any item is known; each item
descends depth first into the subtrees with the highest bounds and leaves out those that cannot reach its tenth best
document so far. Bounds and scores are the same integer formula, so nothing is lost by rounding. A task keeps the best
documents of every item from tree to tree; the best of all tasks are merged by rank.

Items are searched in blocks of a bounded number of terms, each block against all documents; only a block's terms and
weights are sent to the tasks.

Defined results: a null or wordless text has no terms, is not counted in the statistics and is found by nothing; an
item without terms has no result; rows of an equal item_id are one item with the terms of all of them; a null item_id
is an item of its own; repeated documents are ranked each; a null doc_id comes before all others among equal scores;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terraloom.llm import text as tx
from terraloom.session import cut_lineage

TOP = 10
#: Documents, and entries of their vectors, in a tree.
TREE_DOCS, TREE_ENTRIES = 8192, 1 << 20
#: Documents of a subtree that is not divided further, and bytes of the maxima of a tree, to which leaves grow if need be.
LEAF_DOCS, MAXIMA_BYTES = 32, 64 << 20
#: Distinct pairs of item and term in a block of items; a single item may have more.
BLOCK_TERMS = 1 << 16
#: The score: w * ((SCALE * tf) div (TF * tf + M * m)) with m = 100 - B + (B * n * N) div L (fixed values of the formula).
SCALE, TF, M, B = 1_000_000_000, 1000, 8, 90
NO_ID = np.iinfo(np.int64).min

#: Letters in lower case, digits and all bytes above ASCII belong to terms; all else is a space.
_FOLDED = np.full(256, 32, dtype=np.uint8)
_FOLDED[128:] = np.arange(128, 256)
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _FOLDED[ord(_a) : ord(_b) + 1] = np.arange(ord(_a), ord(_b) + 1)
_FOLDED[ord("A") : ord("Z") + 1] += 32

TREE = "n_docs long, n_terms long, vectors long, doc_ids binary, sizes binary, starts binary, terms binary, tfs binary, df binary"


def terms(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and term of every occurrence in a text column."""
    offsets, data = tx.buffers(column)
    folded = pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_FOLDED[data].tobytes()))
    split = pc.ascii_split_whitespace(folded)
    row = np.repeat(np.arange(len(column)), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    filled = pc.not_equal(flat, "")  # white space at an end leaves an empty part
    return row[filled.to_numpy(zero_copy_only=False)], flat.filter(filled).dictionary_encode()


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct ``item_id, term`` of all items, written once."""
    kind = items.schema["item_id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch):
                row, found = terms(piece.column("text"))
                ids = piece.column("item_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, found.cast(pa.string())], names=["item_id", "term"])

    rows = tx.bounded(items).select("item_id", F.col("text").cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(split, f"item_id {kind.simpleString()}, term string").distinct())


def trees_of(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Restricted vectors of ``TREE_DOCS`` documents a row, with the number of documents and terms that they stand for
    and the document frequency of every term among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = pa.array(vocabulary, pa.string()), _Held(len(vocabulary))
        for batch in batches:
            for piece in tx.slices(batch):
                held.add(piece, known)
                if held.full():
                    yield held.row()
                    held = _Held(len(vocabulary))
                    tx.release_memory()
        yield held.row()

    rows = tx.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(run, TREE), compression="zstd")


class _Held:
    """Restricted vectors on their way into one row."""

    def __init__(self, n_terms: int):
        self._parts: list[tuple] = []
        self._docs = self._terms = self._vectors = self._entries = 0
        self._df = np.zeros(n_terms, dtype=np.int64)

    def add(self, piece: pa.RecordBatch, known: pa.Array) -> None:
        row, found = terms(piece.column("text"))
        size = np.bincount(row, minlength=piece.num_rows)
        self._docs += int((size > 0).sum())
        self._terms += len(row)
        if not len(known) or not len(row):
            return
        at = pc.index_in(found.dictionary, value_set=known).fill_null(-1).to_numpy()[found.indices.to_numpy()]
        key, tf = np.unique(row[at >= 0] * len(known) + at[at >= 0], return_counts=True)
        owner, term = key // len(known), key % len(known)
        rows, start = np.unique(owner, return_index=True)
        ids = piece.column("doc_id").fill_null(NO_ID).to_numpy()[rows]
        self._parts.append((ids, size[rows], np.diff(np.append(start, len(key))), term.astype(np.int32), tf.astype(np.int32)))
        self._df += np.bincount(term, minlength=len(known))
        self._vectors += len(rows)
        self._entries += len(key)

    def full(self) -> bool:
        return self._vectors >= TREE_DOCS or self._entries >= TREE_ENTRIES

    def row(self) -> pa.RecordBatch:
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int32),) * 2
        ids, sizes, lengths, term, tf = (np.concatenate(x) for x in zip(*self._parts or [empty], strict=True))
        starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        numbers = [pa.array([x], pa.int64()) for x in (self._docs, self._terms, self._vectors)]
        binaries = [pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes.astype(np.int64), starts, term, tf, self._df)]
        return pa.RecordBatch.from_arrays(numbers + binaries, names=[c.split()[0] for c in TREE.split(", ")])


def statistics(trees: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and document frequencies: one number for each term of the block."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(n_terms + 2, dtype=np.int64), False
        for batch in batches:
            for docs, n, df in zip(*(batch.column(c).to_pylist() for c in ("n_docs", "n_terms", "df")), strict=True):
                total[:2] += (docs, n)
                total[2:] += np.frombuffer(df, np.int64)
                some = True
        if some:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    sums = trees.select("n_docs", "n_terms", "df").mapInArrow(summed, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(n_terms + 2, dtype=np.int64)
    for row in sums.toLocalIterator():
        total[row["at"]] = row["n"]
    return int(total[0]), int(total[1]), total[2:]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_weights(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``m`` of documents by their numbers of terms."""
    if len(sizes) and B * int(sizes.max()) * n_docs >= 1 << 63:
        return np.array([100 - B + (B * int(n) * n_docs) // n_terms for n in sizes], dtype=np.int64)
    return 100 - B + (B * sizes * n_docs) // max(n_terms, 1)


class Tree:
    """A document tree over restricted vectors whose terms are numbered by descending document frequency."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        lengths = np.diff(starts)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((term, owner))
        term, tf = term[order], tf[order]
        paths = term.astype(">i4").tobytes()
        cuts = (starts * 4).tolist()
        by_path = np.array(sorted(range(len(lengths)), key=lambda k: paths[cuts[k] : cuts[k + 1]]), dtype=np.int64)
        # The documents in the order of their paths: equal beginnings lie side by side.
        self.doc_ids, self.m, lengths = doc_ids[by_path], m[by_path], lengths[by_path]
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        entry = np.repeat(starts[by_path] - self.starts[:-1], lengths) + np.arange(len(term))
        self.term, self.tf = term[entry], tf[entry].astype(np.int64)
        self.gain = SCALE * self.tf // (TF * self.tf + M * np.repeat(self.m, lengths))
        leaf = max(LEAF_DOCS, 2 * len(lengths) * n_terms * 4 // MAXIMA_BYTES)
        self.low, self.high, self.children = self._divided(leaf)
        self._bound(n_terms)

    def _divided(self, leaf: int) -> tuple[list[int], list[int], list[list[int]]]:
        """Subtrees as stretches of documents; parents come before their children."""
        starts, term, lengths = self.starts, self.term, np.diff(self.starts)
        low, high, children = [0], [len(lengths)], [[]]
        waiting = [(0, 0)]
        while waiting:
            node, depth = waiting.pop()
            a, b = low[node], high[node]
            if b - a <= leaf:
                continue
            # What all paths of a sorted stretch share, its first and last one share.
            first, last = term[starts[a] + depth : starts[a + 1]], term[starts[b - 1] + depth : starts[b]]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[:n] != last[:n])
            depth += int(differ[0]) if len(differ) else n
            at = starts[a:b] + depth
            inside = depth < lengths[a:b]
            branch = np.where(inside, term[np.minimum(at, len(term) - 1)], -1)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(branch)) + 1, [b - a]))
            if len(cuts) == 2:  # all documents have the same terms
                continue
            for x, y in _grouped(cuts.tolist(), leaf):
                low.append(a + x)
                high.append(a + y)
                children.append([])
                children[node].append(len(low) - 1)
                # A stretch of several small branches is a leaf; one branch goes on behind its first term.
                if y - x > leaf and branch[x] >= 0:
                    waiting.append((len(low) - 1, depth + 1))
        return low, high, children

    def _bound(self, n_terms: int) -> None:
        nodes = len(self.low)
        self.maxima = np.zeros((nodes, n_terms), dtype=np.int32)
        self.least_m, self.least_id = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):
            a, b, own = self.low[node], self.high[node], self.children[node]
            if own:
                self.maxima[node] = self.maxima[own].max(axis=0)
                self.least_m[node], self.least_id[node] = self.least_m[own].min(), self.least_id[own].min()
            else:
                entries = slice(self.starts[a], self.starts[b])
                np.maximum.at(self.maxima[node], self.term[entries], self.tf[entries].astype(np.int32))
                self.least_m[node], self.least_id[node] = self.m[a:b].min(), self.doc_ids[a:b].min()

    def bounds(self, nodes: list[int], terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The highest score that a document of each subtree can have."""
        tf = self.maxima[np.ix_(nodes, terms)].astype(np.int64)
        return (SCALE * tf // (TF * tf + M * self.least_m[nodes][:, None])) @ weights

    def search(self, terms: np.ndarray, weights: np.ndarray, of_term: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Puts the tree's documents among the ``best`` (a heap of score and negative doc_id); ``of_term``: the weights
        of the item's terms, 0 for others."""
        stack = [(int(self.bounds([0], terms, weights)[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or (len(best) == top and (bound, -int(self.least_id[node])) <= best[0]):
                continue
            own = self.children[node]
            if own:
                found = self.bounds(own, terms, weights)
                stack += [(int(found[k]), own[k]) for k in np.argsort(found, kind="stable")]
                continue
            a, b = self.low[node], self.high[node]
            entries = slice(self.starts[a], self.starts[b])
            scores = np.add.reduceat(of_term[self.term[entries]] * self.gain[entries], self.starts[a:b] - self.starts[a])
            least = best[0][0] if len(best) == top else 1
            for k in np.flatnonzero(scores >= least).tolist():
                candidate = (int(scores[k]), -int(self.doc_ids[a + k]))
                if len(best) < top:
                    heapq.heappush(best, candidate)
                elif candidate > best[0]:
                    heapq.heapreplace(best, candidate)


def _grouped(cuts: list[int], leaf: int) -> Iterator[tuple[int, int]]:
    """Branches between cuts, small neighbours together up to the size of a leaf."""
    start = cuts[0]
    for at, to in zip(cuts[:-1], cuts[1:], strict=True):
        if at > start and to - start > leaf:
            yield start, at
            start = at
    yield start, cuts[-1]


def _searched(trees: DataFrame, items: list, item_vectors: list[np.ndarray], kind, n_docs: int, n_terms: int, df: np.ndarray, top: int) -> DataFrame:
    """The best documents of every item among those of each task."""
    by_frequency = np.argsort(-df, kind="stable")
    place = np.empty(len(df), dtype=np.int32)
    place[by_frequency] = np.arange(len(df))
    weights = np.array([weight(n_docs, int(x)) for x in df[by_frequency]], dtype=np.int64)
    vectors = [np.sort(place[v]) for v in item_vectors]
    arrow = to_arrow_type(kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        of_term = np.zeros(len(df), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if not row["vectors"]:
                    continue
                ids, sizes, starts = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "sizes", "starts"))
                own, tf = (np.frombuffer(row[c], np.int32) for c in ("terms", "tfs"))
                tree = Tree(ids, length_weights(sizes, n_docs, n_terms), starts, place[own], tf, len(df))
                for vector, heap in zip(vectors, best, strict=True):
                    of_term[vector] = weights[vector]
                    tree.search(vector, weights[vector], of_term, heap, top)
                    of_term[vector] = 0
                del tree
                tx.release_memory()
        out = [(item, None if -d == NO_ID else -d, s) for item, heap in zip(items, best, strict=True) for s, d in heap]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((arrow, pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    wanted = trees.filter("vectors > 0").select("vectors", "doc_ids", "sizes", "starts", "terms", "tfs")
    return wanted.mapInArrow(search, f"item_id {kind.simpleString()}, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of every item: ``item_id``, ``rank`` from 1, ``doc_id`` and ``score``."""
    kind = items.schema["item_id"].dataType
    pairs = item_terms(items)
    blocks = max(1, -(-pairs.count() // block_terms))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    found = None
    for block in range(blocks):
        # A block is bounded by block_terms, but for chance and for an item that has more terms alone.
        own: dict = {}
        for row in dealt.filter(F.col("block") == block).toLocalIterator():
            own.setdefault(row["item_id"], []).append(row["term"])
        vocabulary = sorted({t for known in own.values() for t in known})
        number = {t: k for k, t in enumerate(vocabulary)}
        vectors = [np.array([number[t] for t in known], dtype=np.int64) for known in own.values()]
        trees = trees_of(docs, vocabulary)
        n_docs, n_terms, df = statistics(trees, len(vocabulary))
        best = cut_lineage(_searched(trees, list(own), vectors, kind, n_docs, n_terms, df, top))
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
