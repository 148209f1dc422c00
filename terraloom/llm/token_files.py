"""Token ids in files of Simple-8b blocks.

A token file set is a folder of Parquet files that Spark writes and reads, so any store of Spark's will do. A row
is a block of whole documents: their ids, the end of each in the block, 64-bit words of packed token ids, and
escapes. ``part`` and ``block`` give the order, ``first`` the number of ids of the part before the block; with
these offsets blocks are decoded on their own.

Defined results: a null text is empty and has the end id alone; null doc_ids come first; rows with equal ids follow
each other in any order; an empty table gives a file set without blocks.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terraloom.llm import simple8b
from terraloom.llm.text import bounded, slices

#: Ids after which a block is closed; documents are not cut.
BLOCK_IDS = 1 << 16
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 8 << 20
#: Pre-tokens in one of the two generations that a worker keeps; a smaller store costs time only.
MAX_STORED = 500_000
BLOCK_SCHEMA = (
    "part int, block int, first long, doc_ids array<long>, ends array<int>, words binary, escape_positions array<int>, escape_ids array<int>"
)
#: A run of Latin letters, about which all engines agree, and what follows it if that is ASCII and no letter.
_WORD_AND_REST = r"^(?P<word>[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]+)(?P<rest>(?s:[\x00-@\[-`{-\x7F].*)?)$"
#: How byte-level vocabularies write a space, and parts encoded as one text.
_SPACE = "\u0120"
_TOGETHER = 512
_SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts, by the tokenizers library.

    A single space between two characters that are not white space always starts a new pre-token, and so does an
    ASCII character that is no letter after a run of letters. What lies between is encoded alone, each distinct
    part of a piece once; a worker keeps the ids of such parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._after_space = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._after_space[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self._specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        #: Two generations: when the young one is full it becomes the old one, and what is used again is kept.
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        units = pc.split_pattern(texts, " ")
        cuts = units.offsets.to_numpy()
        flat = units.flatten().dictionary_encode()
        entry, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        firsts = names.take(pa.array(entry[cuts[:-1]])).to_pylist()
        # A unit that is empty or has white space at an end belongs to a longer run of white space.
        odd = pc.or_(pc.equal(pc.utf8_length(names), 0), pc.not_equal(names, pc.utf8_trim_whitespace(names)))
        # Distinct units as a head, which starts with the space, and a tail; and the texts' first units.
        found = pc.extract_regex(names, _WORD_AND_REST)
        split = found.is_valid()
        heads = pc.binary_join_element_wise(" ", pc.if_else(split, pc.struct_field(found, "word"), names), "")
        heads = pc.if_else(odd, "", heads).dictionary_encode()
        tails = pc.if_else(split, pc.struct_field(found, "rest"), "").dictionary_encode()
        parts = heads.dictionary.to_pylist() + tails.dictionary.to_pylist() + firsts
        coded = self._of(parts)
        ids = np.frombuffer(b"".join(coded), dtype="<u4")
        length = np.fromiter(map(len, coded), dtype=np.int64, count=len(parts)) // 4
        begin = np.cumsum(length) - length
        # The ids of each distinct unit and of each first one, side by side; then those of all units, in place.
        pair = np.column_stack((heads.indices.to_numpy(), tails.indices.to_numpy().astype(np.int64) + len(heads.dictionary))).reshape(-1)
        pair = np.concatenate((pair, np.arange(len(parts) - len(firsts), len(parts))))
        ids = _gathered(ids, begin[pair], length[pair])
        n = len(names)
        length = np.concatenate((length[pair[: 2 * n]].reshape(-1, 2).sum(axis=1), length[pair[2 * n :]]))
        begin = np.cumsum(length) - length
        entry[cuts[:-1]] = n + np.arange(len(firsts))
        taken = length[entry]
        ids = _gathered(ids, begin[entry], taken)
        bounds = np.concatenate(([0], np.cumsum(taken)))[cuts]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        odd_at = np.concatenate((odd.to_numpy(zero_copy_only=False), np.zeros(len(firsts), dtype=bool)))[entry]
        odd_at[cuts[:-1]] = [b - a > 1 and (not u or u[-1].isspace()) for u, a, b in zip(firsts, cuts[:-1], cuts[1:], strict=True)]
        careful = np.zeros(len(texts), dtype=bool)
        careful[np.searchsorted(cuts, np.flatnonzero(odd_at), side="right") - 1] = True
        special = np.zeros(len(texts), dtype=bool)
        for content in self._specials:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(careful | special):
            text = texts[int(k)].as_py()
            places = [0, *([] if special[k] else [m.start() for m in _SAFE_CUT.finditer(text)]), len(text)]
            out[k] = np.frombuffer(b"".join(self._alone([text[a:b] for a, b in zip(places, places[1:]) if b > a])), dtype="<u4")  # noqa: B905
        return out

    def _of(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, from the store as far as it has them."""
        out = list(map(self._young.get, parts))
        missing = [k for k, coded in enumerate(out) if coded is None]
        if len(self._young) + len(missing) > MAX_STORED:
            self._old, self._young = self._young, {}
        young, new = self._young, []
        for k in missing:
            coded = self._old.get(parts[k])
            if coded is None:
                new.append(k)
            else:
                young[parts[k]] = out[k] = coded
        for k, coded in zip(new, self._ids([parts[k] for k in new]), strict=True):
            young[parts[k]] = out[k] = coded
        return out

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of parts. Parts that start with their only space are encoded side by side: each starts where a token does with a space."""
        spaced = [k for k, p in enumerate(parts) if p and p[0] == " " and " " not in p[1:]]
        if len(spaced) < 2:
            return self._alone(parts)
        together = ["".join([parts[k] for k in spaced[at : at + _TOGETHER]]) for at in range(0, len(spaced), _TOGETHER)]
        ids = np.frombuffer(b"".join(self._alone(together)), dtype="<u4")
        starts = np.flatnonzero(self._after_space[ids])
        if len(starts) != len(spaced):
            return self._alone(parts)
        out: list[bytes] = [b""] * len(parts)
        content, bounds = ids.tobytes(), (np.append(starts, len(ids)) * 4).tolist()
        for k, a, b in zip(spaced, bounds[:-1], bounds[1:], strict=True):
            out[k] = content[a:b]
        rest = sorted(set(range(len(parts))).difference(spaced))
        for k, coded in zip(rest, self._alone([parts[k] for k in rest]), strict=True):
            out[k] = coded
        return out

    def _alone(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def _gathered(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` in order."""
    ends = np.cumsum(length)
    return values[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Writes the ids of all texts to a token file set at ``path``, in ascending order of ``doc_id``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], dtype="<u4")
        part, number, first = TaskContext.get().partitionId(), 0, 0
        names: list[int] = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for piece in slices(batch, limit=ENCODE_BYTES):
                encoded = own.encode(piece.column(1).fill_null(""))
                for name, coded in zip(piece.column(0).to_pylist(), encoded, strict=True):
                    names.append(name)
                    ids.append(np.concatenate((coded, end)))
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield _block(part, number, first, names, ids)
                        number, first, names, ids, held = number + 1, first + held, [], [], 0
        if names:
            yield _block(part, number, first, names, ids)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def _block(part: int, number: int, first: int, names: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([len(i) for i in ids])
    words, positions, escaped = simple8b.pack(np.concatenate(ids))
    values = [
        pa.array([part], pa.int32()),
        pa.array([number], pa.int32()),
        pa.array([first], pa.int64()),
        pa.array([names], pa.list_(pa.int64())),
        pa.array([ends], pa.list_(pa.int32())),
        pa.array([words.astype("<u8").tobytes()], pa.binary()),
        pa.array([positions], pa.list_(pa.int32())),
        pa.array([escaped], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


def unpacked(row: dict) -> np.ndarray:
    """The ids of one block, given as a dict of its columns."""
    ends = row["ends"]
    words = np.frombuffer(row["words"], dtype="<u8")
    return simple8b.unpack(words, ends[-1] if ends else 0, np.array(row["escape_positions"], np.int64), np.array(row["escape_ids"], np.uint64))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), and ``ids`` of every document of a token file set."""

    def ids(row: dict) -> Iterator[tuple]:
        values, begin = unpacked(row).astype(np.int32), 0
        for name, end in zip(row["doc_ids"], row["ends"], strict=True):
            yield name, row["part"], row["first"] + begin, values[begin:end]
            begin = end

    columns = {"doc_id": pa.int64(), "part": pa.int32(), "in_part": pa.int64(), "ids": pa.list_(pa.int32())}
    return _with_starts(spark, path, ids, columns, "ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document of a token file set."""

    def crcs(row: dict) -> Iterator[tuple]:
        values, begin = unpacked(row).astype("<u4").tobytes(), 0
        for name, end in zip(row["doc_ids"], row["ends"], strict=True):
            yield name, row["part"], row["first"] + begin, end - begin, zlib.crc32(values[4 * begin : 4 * end])
            begin = end

    columns = {"doc_id": pa.int64(), "part": pa.int32(), "in_part": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    return _with_starts(spark, path, crcs, columns, "n_tokens long, ids_crc32 long")


def _with_starts(spark: SparkSession, path: str, work, columns: dict[str, pa.DataType], rest: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(work(batch.slice(i, 1).to_pylist()[0]))
                arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=list(columns))

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum(F.element_at("ends", -1).cast("long")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    documents = blocks.mapInArrow(run, f"doc_id long, part int, in_part long, {rest}")
    names = [c.split()[0] for c in rest.split(", ")]
    return documents.join(F.broadcast(starts), "part").select("doc_id", (F.col("in_part") + F.col("part_start")).alias("start"), *names)
