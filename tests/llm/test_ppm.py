"""Distributed scores against the trie in one process, and the word model against plain counts."""

import math
import os
import pathlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraloom.llm import ppm
from terraloom.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR, make_texts

#: A table large enough for contexts of five bytes.
LARGE_DIR = "/root/testdata/sf0.1"


def lower_words(text):
    return (text or "").encode().translate(ppm.LOWER).split() + [ppm.END_WORD]


def base(rows, held):
    counts = Counter(w for k, t in rows if k not in held for w in lower_words(t))
    size, total = len(counts), sum(counts.values())
    return {k: (sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in lower_words(t)), len(lower_words(t)), sum(counts[w] > 0 for w in lower_words(t)), total) for k, t in rows}


@pytest.mark.parametrize(("order", "block_bytes"), [(5, 32 << 20), (2, 3_000), (0, 3_000)])
def test_scores(spark, order, block_bytes):
    rows = [(k, t) for k, t in enumerate(make_texts(seed=3, n=30)) if len(t or "") < 5000]
    held = {k for k, _ in rows if k % 5 == 2}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ppm.scored(frame, ~F.col("doc_id").isin(held), order, block_bytes).collect()}
    trie = ppm.ContextTrie(order)
    for k, t in rows:
        if k not in held:
            trie.learn((t or "").encode())
    words = base(rows, held)
    assert len(got) == len(rows)
    for k, t in rows:
        assert got[k].score == pytest.approx(trie.score((t or "").encode()), rel=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == words[k][1:]
        assert got[k].base_score == pytest.approx(words[k][0], rel=1e-9)


def test_the_model_is_a_distribution():
    trie = ppm.ContextTrie(2)
    for t in (b"abracadabra", b"abc"):
        trie.learn(t)
    for context in (b"ab", b"zz", b"ra", bytes([ppm.BEFORE] * 2)):
        assert sum(10 ** trie.log10_of(context, s) for s in range(255)) == pytest.approx(1)


def test_edges(spark, docs, no_docs):
    assert ppm.scored(no_docs, F.lit(True)).count() == 0
    got = ppm.scored(docs, F.lit(False)).filter("doc_id is not null").collect()
    assert len(got) == docs.count() - 1
    for r in got:
        assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0
    empty = [r for r in got if r.n_tokens == 1 and r.score > -3]
    assert {round(r.score, 9) for r in empty} == {round(-math.log10(255), 9)}


def test_adaptive(spark):
    frame = spark.createDataFrame([(1, "abababababab" * 10), (2, "the quick brown fox jumps over lazy dogs"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.adaptive_scores(frame).collect()}
    assert got[1] > got[2] and got[3] == pytest.approx(-math.log10(255))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2}
    words = base(rows, held)
    got = QUERIES["op4_ppm_scores"](spark, SF_DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id in held)
        assert r.base_score == pytest.approx(words[r.doc_id][0], rel=1e-9)
    texts, unseen = dict(rows), [r for r in got if r.held_out]
    bits = -sum(r.score for r in unseen) / math.log10(2) / sum(len(texts[r.doc_id].encode()) + 1 for r in unseen)
    assert bits < 3.5  # of 8 a byte


def test_the_query_uses_contexts_of_five_bytes(spark):
    # Only the fifth byte before it tells the last letter.
    rows = [(k, ("a" if k % 2 else "b") + "wxyz" + ("1" if k % 2 else "2")) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    trie = ppm.ContextTrie(5)
    for k, t in rows:
        if k >= 20:
            trie.learn(t.encode())
    got = {r.doc_id: r.score for r in ppm.scored(frame, F.col("doc_id") >= 20).collect()}
    for k, t in rows:
        assert got[k] == pytest.approx(trie.score(t.encode()), rel=1e-9)


def test_held_out_texts_score_above_the_word_model(spark):
    got = QUERIES["op4_ppm_scores"](spark, LARGE_DIR).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_blocks_fit_though_the_splits_change(spark, tmp_path):
    # The rows come in other parts at every scan, as after the loss of an executor or from a shuffle.
    rows = [(k, t) for k, t in enumerate(make_texts(seed=9, n=20)) if len(t or "") < 3000]
    passes, mark = spark.sparkContext.accumulator(0), str(tmp_path)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def turned(batches):
        passes.add(1)
        turn = os.path.exists(f"{mark}/seen")
        pathlib.Path(f"{mark}/seen").touch()
        for b in batches:
            yield b.take(list(range(b.num_rows))[::-1]) if turn else b

    got = {r.doc_id: r.score for r in ppm.scored(frame.mapInArrow(turned, frame.schema), F.col("doc_id") % 5 != 2, 2, 3_000).collect()}
    trie = ppm.ContextTrie(2)
    for k, t in rows:
        if k % 5 != 2:
            trie.learn((t or "").encode())
    assert passes.value == 1
    assert got == pytest.approx({k: trie.score((t or "").encode()) for k, t in rows}, rel=1e-9)
