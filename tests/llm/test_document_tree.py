"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from terraloom.llm import document_tree as dt
from tests.llm.conftest import SF_DIR


def terms(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def expected(docs, items, top=10):
    """All results as (item_id, rank, doc_id, score), by plain scoring."""
    vectors = [(k, Counter(terms(t))) for k, t in docs]
    vectors = [(k, v) for k, v in vectors if v]
    n_docs, n_terms = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    of = {}
    for item, text in items:
        of.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in of.items():
        scored = []
        for k, v in vectors:
            m = 10 + (90 * sum(v.values()) * n_docs) // n_terms
            score = 0
            for t in own & v.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * v[t]) // (1000 * v[t] + 8 * m))
            if score > 0:
                scored.append((-score, k is not None, k))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, k, -s) for r, (s, _, k) in enumerate(scored[:top])]
    return sorted(out, key=str)


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("block_terms", [dt.BLOCK_TERMS, 40])
def test_ranked(spark, docs, texts, block_terms):
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(k, t) for k, t in enumerate(texts[:12])] + [(90, None), (91, " ,. "), (None, texts[3]), (92, texts[-1][:4000]), (93, "Zq_ÄÖ9 zq"), (94, "a x")]
    items += [items[2], (2, texts[20])]  # a repeated row, and one item of two rows
    frame = spark.createDataFrame([(*i, "x", 1, 2, "y") for i in items], "item_id long, text string, term string, doc_id long, rank int, score string")
    found = dt.ranked(docs, frame, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == expected(own, items)


def test_whole_tables(spark):
    own, items = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    plain = ([tuple(r) for r in own.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows(dt.ranked(own, items)) == expected(*plain)
    assert rows(dt.ranked(own, items, top=3)) == expected(*plain, top=3)


def test_empty_tables(spark, docs, no_docs):
    no_items, items = spark.createDataFrame([], "item_id string, text string"), spark.createDataFrame([("a", "word token")], "item_id string, text string")
    assert dt.ranked(docs, no_items).count() == 0
    assert dt.ranked(no_docs, items).count() == 0
    assert {r.item_id for r in dt.ranked(docs, items).collect()} <= {"a"}


@pytest.mark.parametrize("copies", [1, 40])
def test_tree_prunes_without_loss(copies):
    """Branch and bound over deep trees with many ties gives what scoring all documents gives."""
    rng = np.random.default_rng(copies)
    n_terms = 60
    sets = [np.flatnonzero(rng.random(n_terms) < 1 / (1 + np.arange(n_terms) / 6)) for _ in range(2400 // copies)]
    sets = [s if len(s) else np.array([0]) for s in sets for _ in range(copies)]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    term, ids = np.concatenate(sets).astype(np.int32), rng.permutation(len(sets)).astype(np.int64)
    tf = rng.integers(1, 4, len(term)).astype(np.int32) if copies == 1 else np.ones(len(term), np.int32)
    m = rng.integers(10, 400, len(sets)) if copies == 1 else np.full(len(sets), 90)
    tree = dt.Tree(ids, m, starts, term, tf, n_terms)
    leaves = [k for k, own in enumerate(tree.children) if not own]
    assert sorted((tree.low[k], tree.high[k]) for k in leaves)[0][0] == 0 and sum(tree.high[k] - tree.low[k] for k in leaves) == len(sets)
    weights = rng.integers(0, 3000, n_terms)
    for _ in range(20):
        own = np.flatnonzero(rng.random(n_terms) < 0.3)
        of_term = np.zeros(n_terms, dtype=np.int64)
        of_term[own] = weights[own]
        best = []
        tree.search(own, weights[own], of_term, best, 10)
        scores = []
        for k in range(len(sets)):
            part = slice(starts[k], starts[k + 1])
            t = tf[part].astype(np.int64)
            scores.append((int((of_term[term[part]] * (dt.SCALE * t // (dt.TF * t + dt.M * m[k]))).sum()), -int(ids[k])))
        assert sorted(best, reverse=True) == [s for s in sorted(scores, reverse=True)[:10] if s[0] > 0]


def test_length_weights_beyond_64_bits():
    big = np.array([10**9, 3], dtype=np.int64)
    assert dt.length_weights(big, 10**10, 10**13).tolist() == [10 + 90 * 10**9 * 10**10 // 10**13, 10]
