"""Near-duplicate classes against all pairs, and the estimator against exact similarities."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from terraloom.llm import prob_minhash
from terraloom.llm import text as tx
from terraloom.llm.graph import components
from tests.llm.conftest import SF_DIR, make_texts
from tests.llm.test_rowwise import thue_morse


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """doc_id to class_id by all pairs of texts."""
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts, first = {}, {}
    for k, t in sorted(r for r in rows if r[0] is not None):
        parent[k] = k
        if t is not None and t in first:
            parent[k] = first[t]
        elif t is not None:
            first[t] = k
            texts[k] = shingle_set(t)
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(texts[a] & texts[b])
        if both and both / len(texts[a] | texts[b]) >= 0.8:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {k: root(k) for k in parent}


def near_rows():
    rows = list(enumerate(make_texts(seed=21, n=40)))
    base = [f"w{k}" for k in range(120)]
    # A chain: neighbours are close, ends are not; and a ring of edits around one text.
    for k in range(12):
        rows.append((200 + k, " ".join(base[:20] + [f"x{j}" for j in range(k)] + base[20 + k :])))
    for k in range(20):
        w = list(base)
        for j in range(k % 4):
            w[(k * 7 + j * 31) % 120] = f"edit{k}"
        rows.append((300 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("weighted", "block_texts"), [(False, 256), (False, 3)])
def test_classes(spark, monkeypatch, weighted, block_texts):
    monkeypatch.setattr(prob_minhash, "BLOCK_TEXTS", block_texts)
    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(frame, weighted=weighted).collect()}
    assert got == expected(rows)


def test_smallest_tables(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(frame).collect()}
    assert got == expected(rows)
    kept = prob_minhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_edges(spark, docs, no_docs):
    got = prob_minhash.classes(docs).collect()
    assert len(got) == docs.count()
    kept = prob_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({r.class_id for r in got if r.doc_id is not None})
    assert prob_minhash.classes(no_docs).count() == 0 and prob_minhash.one_of_each(no_docs).count() == 0


def exact_probability_jaccard(a, b):
    out = 0.0
    for d in a.keys() & b.keys():
        out += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return out


def test_weighted_similarity_and_its_estimate():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = ({int(e): int(rng.integers(1, 6)) for e in rng.integers(1, 60, 40)} for _ in range(2))
        packed = [np.array([*sorted(x), *(x[e] for e in sorted(x))], dtype=np.uint64).tobytes() for x in (a, b)]
        assert prob_minhash.similarity(*packed, True) == pytest.approx(exact_probability_jaccard(a, b))
    m = 4000
    keys = tx.mix(np.array([*a, *b], dtype=np.uint64))
    weights = np.array([*a.values(), *b.values()], dtype=float)
    row = np.repeat([0, 1], [len(a), len(b)])
    taken = prob_minhash.registers(row, keys, weights, 2, m)
    assert (taken[0] == taken[1]).mean() == pytest.approx(exact_probability_jaccard(a, b), abs=0.04)


def test_shingles_of_short_texts():
    offsets, data = tx.buffers(pa.array(["a b", "a  b", "b a", "", "a b c d e f"]))
    row, key, times = prob_minhash.shingles(offsets, data)
    assert row.tolist() == [0, 1, 2, 4, 4] and times.tolist() == [1] * 5
    assert key[0] == key[1] != key[2]


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 2000), (2000, 1500)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 2000: 1000, 1500: 1000}


def test_unlike_texts_with_equal_polynomials(spark):
    """A Thue-Morse word and its complement stay two texts, alone and beside an equal word."""
    one, two = thue_morse(12)
    frame = spark.createDataFrame([(1, one), (2, two), (3, f"{one} x"), (4, f"{two} x"), (5, one)], "doc_id long, text string")
    assert {r.doc_id: (r.text_id, r.class_id) for r in prob_minhash.classes(frame).collect()} == {1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (4, 4), 5: (1, 1)}


def test_one_of_each_goes_by_text(spark):
    """Rows with equal ids and different texts: copies go, what is in no other row stays; ids do not tie texts together."""
    a, b, c, d = ("text a", "text b", " ".join(f"c{k}" for k in range(80)), " ".join(f"d{k}" for k in range(80)))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, d), (8, c + " end"), (9, d + " end"), (9, None), (9, None), (None, a), (None, None)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, k1 int")
    found = prob_minhash.one_of_each(frame)
    assert found.columns == frame.columns
    kept = [(1, a), (5, b), (7, c), (7, d), (9, None), (None, a), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(str, kept))
    assert {(r.doc_id, r.class_id) for r in prob_minhash.classes(frame).collect()} == {(1, 1), (5, 1), (5, 5), (7, 7), (8, 7), (9, 7), (9, 9), (None, 1), (None, None)}
