"""Quality rules with verdicts on hosts.

Every document is counted on its own. Rule failures are then added up by host, each host's failure rate is
shrunk towards all hosts by a beta prior that is fitted to the hosts themselves, and the host's verdict is
joined back to its documents.

Defined results: a null text counts as one without words, so it fails; a null host is a host of its own;
repeated rows are counted as often as they occur; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import text as tx
from terraloom.llm.text import bounded, row_wise
from terraloom.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents: hosts that differ wildly, hosts that do not differ at all.
STRENGTH = (1.0, 1_000_000.0)
#: Symbols that count against a text (fixed values of the rule).
SYMBOLS = "#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def count_text(column: pa.Array) -> list[np.ndarray]:
    """The five counts of every text of a column."""
    offsets, data = tx.buffers(column)
    rows = len(offsets) - 1
    row, start, end = tx.words(offsets, data)
    span = tx.SoundSpanHash(data)
    word = np.concatenate(([0], np.cumsum(~tx.SPACE[data])))
    chars = tx.per_row(~tx.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    return [
        np.bincount(row, minlength=rows),
        chars,
        tx.per_row(_SYMBOL[data], offsets),
        _repeated_lines(offsets, data, span, word, rows),
        _repeated_words(row, span(start, end), rows),
    ]


def _repeated_lines(offsets: np.ndarray, data: np.ndarray, span: tx.SoundSpanHash, word: np.ndarray, rows: int) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    row = np.searchsorted(offsets, start, side="right") - 1
    start, row = start[row < rows], row[row < rows]
    end = np.minimum(np.concatenate((start[1:], [len(data)])), offsets[row + 1])
    end = end - ((end > start) & (data[np.maximum(end, 1) - 1] == 10) if len(data) else 0)
    worded = word[end] > word[start]
    start, end, row = start[worded], end[worded], row[worded]
    key = tx.mix(span(start, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[first] = False
    return np.bincount(row[again], minlength=rows)


def _repeated_words(row: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
    if len(row) < 3:
        return np.zeros(rows, dtype=np.int64)
    whole = np.flatnonzero(row[:-2] == row[2:])
    key = word[whole] * np.uint64(3) + np.uint64(1)
    for step in (1, 2):
        key = tx.mix(key) + word[whole + step]
    key = tx.mix(key + row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(len(row), dtype=bool)
    for step in range(3):
        covered[whole[often] + step] = True
    return np.bincount(row[covered], minlength=rows)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the counts of the whole text and ``base_failed``."""

    @F.arrow_udf(returnType=COUNTS)
    def counts(column: pa.Array) -> pa.Array:
        return row_wise(column, count_text, [c.split()[0] for c in COUNTS.split(", ")])

    counted = bounded(docs).select(*keep, counts(F.col("text").cast("string")).alias("_counts")).select(*keep, "_counts.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(documents: DataFrame, host: str = "host", failed: str = "base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk ``rate`` and ``host_rejected``.

    The prior is a beta distribution with the mean of all documents and the variance of the hosts' rates
    beyond what chance alone gives (method of moments).
    """
    return _verdicts_of(_host_counts(documents, host, failed), max_rate)


def _host_counts(documents: DataFrame, host: str, failed: str) -> DataFrame:
    return documents.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.col(failed).cast("long")).alias("n_failed")
    )


def _verdicts_of(hosts: DataFrame, max_rate: float) -> DataFrame:
    own = F.col("n_failed") / F.col("n_documents")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_documents")).alias("mean"),
        F.var_samp(own).alias("spread"),
        F.avg(1 / F.col("n_documents")).alias("noise"),
    )
    chance = F.col("mean") * (1 - F.col("mean"))
    true_spread = F.coalesce(F.col("spread"), F.lit(0.0)) - chance * F.col("noise")
    strength = F.when(true_spread > 0, F.least(F.greatest(chance / true_spread - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(STRENGTH[1])
    prior = prior.select("mean", strength.alias("strength"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_documents") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > max_rate).drop("mean", "strength")


def judged(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every document with its counts, ``base_failed``, its host's verdict and ``kept``."""
    counted = cut_lineage(measured(docs.select("doc_id", "text", F.col(host).alias("host")), "doc_id", "host"))
    rejected = host_verdicts(counted, max_rate=max_rate).filter("host_rejected").select(F.col("host").alias("_bad"), F.lit(True).alias("_rejected"))
    out = counted.join(cut_lineage(rejected), F.col("host").eqNullSafe(F.col("_bad")), "left")
    return out.withColumn("host_rejected", F.coalesce("_rejected", F.lit(False))).select(
        *counted.columns, "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept")
    )


def kept_documents(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: the own rules by row, then the hosts' verdicts."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    counted = measured(docs.select(whole.alias("_doc"), F.col(host).alias("_host"), "text"), "_doc", "_host")
    hosts = cut_lineage(_host_counts(counted, "_host", "base_failed"))
    rejected = cut_lineage(_verdicts_of(hosts, max_rate).filter("host_rejected").select(F.col("host").alias("_bad")))
    passed = counted.filter(~F.col("base_failed"))
    return passed.join(rejected, F.col("_host").eqNullSafe(F.col("_bad")), "left_anti").select("_doc.*")
