"""Token counts under a unigram model, with one forward pass per shared prefix.

Pre-tokens are words with a space before them. The distinct ones of a batch form a trie: they are visited in
sorted order, which is the trie's depth-first order, and the stack of forward scores of the last path is cut
back to the shared prefix. So a prefix's best segmentation is worked out once; terminal counts are stored per
pre-token and looked up for every occurrence.

A piece's probability follows from its rank in a public vocabulary by the Zipf-Mandelbrot law; no tokenizer is
trained. Of equally probable segmentations the one with the longest last piece is taken.

Defined results: a null or wordless text has no tokens and log probability 0; repeated rows are counted each.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.text import bounded, row_wise

#: Offset of ranks in the Zipf-Mandelbrot law.
RANK_SHIFT = 2.7
#: Pre-tokens whose counts one worker keeps; beyond it the store starts anew, which costs time only.
MAX_STORED = 200_000

_models: dict[str, "UnigramTrie"] = {}


class UnigramTrie:
    """Forward scores over a trie of pre-tokens, for the pieces of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        total = math.log(sum(1 / (rank + RANK_SHIFT) for rank in ranks.values()))
        #: Pieces by their bytes from last to first; a node's value is under the key -1.
        self._pieces: dict = {}
        for piece, rank in ranks.items():
            node = self._pieces
            for byte in reversed(piece):
                node = node.setdefault(byte, {})
            node[-1] = -math.log(rank + RANK_SHIFT) - total
        self.tokens: dict[bytes, int] = {}
        self.scores: dict[bytes, float] = {}

    def add(self, words: set[bytes]) -> None:
        """Stores the token count and score of every word that has none yet."""
        new = sorted(words - self.tokens.keys())
        if len(self.tokens) + len(new) > MAX_STORED:
            self.tokens.clear()
            self.scores.clear()
            new = sorted(words)
        pieces, tokens, scores = self._pieces, self.tokens, self.scores
        best, count, last = [0.0], [0], b""
        for word in new:
            path = b" " + word
            shared = 0
            for a, b in zip(path, last):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(path) + 1):
                node, top, start, taken = pieces, -math.inf, end, end
                while start and (node := node.get(path[start - 1])) is not None:
                    start -= 1
                    value = node.get(-1)
                    if value is not None and best[start] + value >= top:
                        top, taken = best[start] + value, start
                best.append(top)
                count.append(count[taken] + 1)
            tokens[word], scores[word] = count[-1], best[-1]
            last = path


def model(path: str) -> UnigramTrie:
    if path not in _models:
        with open(path, "rb") as lines:
            _models[path] = UnigramTrie({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})
    return _models[path]


def counted(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id``, ``n_pretokens``, ``n_tokens`` and ``log_probability`` (natural) of every text's best segmentation."""

    @F.arrow_udf(returnType="n_pretokens long, n_tokens long, log_probability double")
    def count(column: pa.Array) -> pa.Array:
        trie = model(ranks)

        def work(texts: pa.Array) -> list:
            lists = [(text or "").encode().split() for text in texts.to_pylist()]
            trie.add({word for words in lists for word in words})
            return [
                pa.array([len(words) for words in lists], pa.int64()),
                pa.array([sum(map(trie.tokens.__getitem__, words)) for words in lists], pa.int64()),
                pa.array([sum(map(trie.scores.__getitem__, words), 0.0) for words in lists], pa.float64()),
            ]

        return row_wise(column, work, ["n_pretokens", "n_tokens", "log_probability"])

    return bounded(docs).select("doc_id", count(F.col("text").cast("string")).alias("_c")).select("doc_id", "_c.*")
