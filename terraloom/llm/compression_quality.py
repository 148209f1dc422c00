"""Quality by compression: a text is close to what compresses it well.

Two zstandard dictionaries are built from well and badly labelled texts. A text's score is the difference of its
sizes under the two, per byte, turned into a probability by a logistic fit on labelled texts that built no
dictionary. Whole texts are compressed, in pieces, so that every part meets the dictionaries.

The fit takes a bounded sample of labelled rows: at most ``SAMPLE_ROWS`` of each label, of texts of at most
``SAMPLE_TEXT_BYTES``; half of them build the dictionaries and half the fit. The share of each label over all
labelled rows corrects the fit for the equal sampling. The model is two dictionaries of ``DICTIONARY_BYTES``.

Defined results: a null or empty text scores as no difference does; without labels of both kinds every score is
the share of label 1, or one half without any label; null labels are not used; repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.text import bounded, row_wise

SAMPLE_ROWS = 4000
SAMPLE_TEXT_BYTES = 1 << 16
DICTIONARY_BYTES = 1 << 15
TRAIN_PIECE = 512
SCORE_PIECE = 1024
LEVEL = 3

_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


@dataclass
class Model:
    """Dictionaries (None without enough labels) and the logistic fit."""

    good: bytes | None
    bad: bytes | None
    slope: float
    intercept: float

    def differences(self, texts: list[bytes]) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.zeros(len(texts))
        good, bad = _compressor(self.good), _compressor(self.bad)
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            difference = 0
            for at in range(0, len(text), SCORE_PIECE):
                piece = text[at : at + SCORE_PIECE]
                difference += len(good.compress(piece)) - len(bad.compress(piece))
            out[k] = difference / len(text) if text else 0.0
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.intercept, -500, 500)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _compressors:
        if len(_compressors) > 3:
            _compressors.clear()
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        _compressors[dictionary] = zstandard.ZstdCompressor(
            dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )
    return _compressors[dictionary]


def _dictionary(texts: list[bytes]) -> bytes | None:
    pieces = [text[at : at + TRAIN_PIECE] for text in texts for at in range(0, len(text), TRAIN_PIECE)]
    if not pieces:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept, both classes with equal weight, with a slight pull to 0; by Newton's method."""
    scale = float(np.std(x)) or 1.0
    design = np.column_stack((x / scale, np.ones(len(x))))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        slope = design.T @ (weight * (y - p)) - np.array([1e-2, 0]) * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows of ``labels`` (``doc_id`` and ``label``) and their texts."""
    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    prior = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    drawn = []
    for kind in (0, 1):
        # The sample is bounded, and so is its broadcast: at most ``rows`` ids.
        ids = known.filter(F.col("label") == kind).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text").between(1, SAMPLE_TEXT_BYTES))
        found = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("text").collect()
        drawn.append([r.text.encode() for r in found])
    bad, good = ([texts[::2], texts[1::2]] for texts in drawn)
    model = Model(_dictionary(good[0]), _dictionary(bad[0]), 0.0, prior)
    if model.good is None or model.bad is None or not good[1] or not bad[1]:
        return Model(None, None, 0.0, prior)
    x = model.differences(bad[1] + good[1])
    y = np.concatenate((np.zeros(len(bad[1])), np.ones(len(good[1]))))
    slope, intercept = _logistic(x, y)
    return Model(model.good, model.bad, slope, intercept + prior)


def scored(docs: DataFrame, model: Model, keep: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the ``score`` of every whole text: the probability of label 1."""

    @F.arrow_udf(returnType="double")
    def score(column: pa.Array) -> pa.Array:
        parts = row_wise(column, lambda texts: [model.scores([(t or "").encode() for t in texts.to_pylist()])], ["score"])
        return parts.field("score")

    return bounded(docs).select(*keep, score(F.col("text").cast("string")).alias("score"))
