"""Removal of repeated strings against a dictionary of all strings of 100 bytes."""

import hashlib

import pytest

from terraloom.llm import suffix_dedup
from terraloom.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR, make_texts


def removed(rows):
    """Per row the removed spans; rows as (doc_id, text) in their order."""
    seen, out = {}, []
    for k, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for i in range(len(data) - 99):
            seen.setdefault(data[i : i + 100], (k, i))
        spans = []
        for i in range(len(data) - 99):
            if seen[data[i : i + 100]] != (k, i):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 100
                else:
                    spans.append([i, i + 100])
        out.append(spans)
    return out


def check(spark, rows, block_bytes, parts=3):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(frame, block_bytes).collect()}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    for (name, text), spans in zip(rows, removed(rows), strict=True):
        data = (text or "").encode()
        assert got[name].spans == [x for s in spans for x in s], name
        mask = [True] * len(data)
        for a, b in spans:
            mask[a:b] = [False] * (b - a)
        assert bytes(got[name].kept or b"") == bytes(x for x, m in zip(data, mask, strict=True) if m)


@pytest.mark.parametrize("block_bytes", [1, 5_000, 32 << 20])
def test_against_all_strings(spark, block_bytes):
    rows = list(enumerate(make_texts(seed=9, n=40)))
    # Passages cut at every place, edits in copies, strings one byte too short, repeats in one text.
    passage = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(260))
    rows += [(200 + k, f"left {k} " + passage[k : k + 130] + f" right {k}") for k in range(40)]
    rows += [(300 + k, passage[: 100 + k] + "#" + passage[100 + k :]) for k in range(0, 60, 7)]
    rows += [(400, passage[:99]), (401, passage[:100]), (402, passage + "-" + passage), (None, passage[50:200]), (403, "é" * 120), (404, "x" + "é" * 120)]
    check(spark, rows, block_bytes)


def test_copies_and_runs(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(k, text) for k in range(50)] + [(60 + k, "z" * (80 + 10 * k)) for k in range(8)] + [(90, "ab" * 400), (91, "b" + "ab" * 400)]
    check(spark, rows, 4_000)


def test_other_columns_and_empty_tables(spark, docs, no_docs, texts):
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    known = {r.doc_id: r for r in left.collect()}
    assert known[texts.index("")].text == "" and known[texts.index(None)].text is None
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in known.values())
    assert suffix_dedup.without_repeats(no_docs).count() == 0


def test_query_on_the_smallest_tables(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op5_suffix_dedup"](spark, SF_DIR).collect()}
    for (name, text), spans in zip(rows, removed(rows), strict=True):
        data, at, kept = text.encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        r = got[name]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), len(data) - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
