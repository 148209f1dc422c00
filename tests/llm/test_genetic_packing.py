"""Packing against plain tokenization, the least number of sequences, and exact packings of small groups."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terraloom.llm import genetic_packing as gp
from tests.llm.conftest import SF_DIR

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, capacity):
    """(doc_id, piece, start, length, ids_crc32) of all pieces, by the tokenizers library alone."""
    own, out = Tokenizer.from_file(PATH), []
    for name, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            out.append((name, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check(found, rows, capacity):
    """All pieces once, sequences without gaps or overlaps; returns the number of sequences and the least possible."""
    found = found.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == expected(rows, capacity)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in found) // capacity)


def test_packed(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = gp.packed(docs, PATH, 0)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n, least = check(found, rows, 2048)
    assert n <= least + 1
    n, least = check(gp.packed(docs, PATH, 0, 300, group_items=20), rows, 300)
    assert n <= least * 1.05 + 1


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n, least = check(gp.packed(docs, PATH, 0), rows, 2048)
    assert n <= least + 1


def test_many_groups(spark):
    """Items dealt over many groups need hardly more sequences than their sum asks for, and equal rows are told apart."""
    rng = np.random.default_rng(4)
    sizes = np.minimum(rng.lognormal(5, 1.2, 6000).astype(int) + 1, 2048)
    items = spark.createDataFrame([(k, int(s)) for k, s in enumerate(sizes)], "item long, length long")
    found = gp.placed(items, group_items=500).join(items, "item").collect()
    assert sorted(r.item for r in found) == list(range(len(sizes)))
    fill = {}
    for r in found:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-int(sizes.sum()) // 2048) * 1.01 + 1


def test_empty_table(spark, no_docs):
    assert gp.packed(no_docs, PATH, 0).count() == 0


def valid(sizes, bins, capacity):
    assert np.bincount(bins, weights=sizes).max() <= capacity
    assert sorted(set(bins.tolist())) == list(range(int(bins.max()) + 1))


@pytest.mark.parametrize("seed", range(4))
def test_operators_keep_packings_valid(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, 300)
    parents = []
    for _ in range(2):
        bins = np.zeros(len(sizes), dtype=np.int64)
        gp.best_fit(sizes, rng.permutation(len(sizes)), bins, np.zeros(0, np.int64), 100)
        parents.append(gp.renumbered(bins))
    for own in parents:
        valid(sizes, own, 100)
    for _ in range(30):
        child = gp.crossover(sizes, *parents, 100, rng)
        valid(sizes, child, 100)
        child = gp.mutated(sizes, child, 100, rng)
        valid(sizes, child, 100)
        parents = [child, parents[0]]


def fewest(sizes, capacity):
    """The exact least number of bins, by subsets."""
    n = len(sizes)
    total = [sum(s for k, s in enumerate(sizes) if mask >> k & 1) for mask in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        low, part = mask & -mask, mask
        while part:
            if part & low and total[part] <= capacity:
                best[mask] = min(best[mask], best[mask ^ part] + 1)
            part = (part - 1) & mask
    return best[-1]


def test_evolved_finds_the_fewest_bins():
    rng = np.random.default_rng(9)
    worse = 0
    for seed in range(12):
        sizes = rng.integers(10, 70, 9)
        bins = gp.evolved(sizes, [], 100, 8, 4, seed)[0]
        valid(sizes, bins, 100)
        worse += int(bins.max()) + 1 - fewest(sizes.tolist(), 100)
    assert worse == 0


def test_evolution_beats_best_fit():
    """Triplets that fill bins exactly: best fit decreasing misses them, crossover of whole bins finds more of them."""
    rng = np.random.default_rng(2)
    one, two = rng.integers(250, 380, 60), rng.integers(250, 380, 60)
    sizes = np.concatenate((one, two, 1000 - one - two))
    plain = np.zeros(len(sizes), dtype=np.int64)
    gp.best_fit(sizes, np.argsort(-sizes), plain, np.zeros(0, np.int64), 1000)
    best = gp.evolved(sizes, [], 1000, 30, 6, 1)[0]
    assert gp.fitness(sizes, best) > gp.fitness(sizes, gp.renumbered(plain))
