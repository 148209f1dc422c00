"""Every stage of the pipeline against a plain version over the stage's own input."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from terraloom.session import cut_lineage
from tests.llm.conftest import SF_DIR
from tests.llm.test_prob_minhash import expected as classes
from tests.llm.test_rowwise import fold, ranks, rule_counts
from tests.llm.test_suffix_dedup import removed


def passed_rules(rows, benchmark):
    out = {}
    for k, t in rows.items():
        counts = rule_counts(t)
        if not (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]):
            out[k] = t
    return out


def one_of_each(rows, benchmark):
    of = classes(list(rows.items()))
    return {k: t for k, t in rows.items() if of[k] == k}


def without_repeats(rows, benchmark):
    ordered = sorted(rows.items())
    out = {}
    for (k, t), spans in zip(ordered, removed(ordered), strict=True):
        data, at, kept = t.encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        out[k] = (kept + data[at:]).decode("utf-8", "ignore")
    return out


def uncontaminated(rows, benchmark):
    windows = set()
    for t in benchmark:
        w = fold(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    lengths = {len(w) for w in windows}
    out = {}
    for k, t in rows.items():
        w = fold(t)
        hit = {i + j for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out[k] = t
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    benchmark = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for (_, stage), plain in zip(corpus_pipeline.STAGES, [passed_rules, one_of_each, without_repeats, uncontaminated], strict=False):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = cut_lineage(stage(spark, docs, SF_DIR))
        assert docs.columns == columns
        after = docs.collect()
        assert {r.doc_id: r.text for r in after} == plain(before, benchmark)
        assert len(after) == len({r.doc_id for r in after})
        assert all(r.n_chars == len(r.text) for r in after)
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    coded = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()}
    for r in docs.collect():
        ids = own.encode_ordinary(r.text)
        assert coded[r.doc_id].ids == ids and coded[r.doc_id].n_tokens == len(ids)
        assert coded[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert len(coded) == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns[0] == "doc_id" and 0 < out.count() <= 200


def test_empty_stages(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF_DIR).count() == 0


def test_stages_bear_odd_rows(spark, docs):
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
        frame = cut_lineage(stage(spark, frame, SF_DIR))
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR).count() == frame.count()
