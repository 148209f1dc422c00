"""Operators that judge each text alone, against plain Python versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken

from terraloom.llm import bpe, compression_quality, decontamination, quality_rules, token_counts
from tests.llm.conftest import by_id

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ranks():
    with open(RANKS, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def expected(docs, work):
    return sorted(([r.doc_id, *work(r.text)] for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r))


def test_token_counts(docs, no_docs):
    pieces = ranks()
    total = math.log(sum(1 / (r + token_counts.RANK_SHIFT) for r in pieces.values()))
    score = {p: -math.log(r + token_counts.RANK_SHIFT) - total for p, r in pieces.items()}
    longest = max(map(len, pieces))

    def best(word):
        path = b" " + word
        table = [(0.0, 0)]
        for end in range(1, len(path) + 1):
            options = [(table[s][0] + score[path[s:end]], s) for s in range(max(0, end - longest), end) if path[s:end] in score]
            top, start = max(options, key=lambda o: (o[0], -o[1]))
            table.append((top, table[start][1] + 1))
        return table[-1]

    def work(text):
        found = [best(w) for w in (text or "").encode().split()] if len(text or "") < 5000 else None
        return [None] if found is None else [len(found), sum(n for _, n in found), round(sum(s for s, _ in found), 6)]

    want = {r[0]: r[1:] for r in expected(docs, work) if r[1] is not None}
    got = token_counts.counted(docs, RANKS).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in want:
            assert [r.n_pretokens, r.n_tokens, round(r.log_probability, 6)] == want[r.doc_id]
    assert token_counts.counted(no_docs, RANKS).count() == 0


def test_a_full_store_starts_anew(monkeypatch):
    trie = token_counts.UnigramTrie(ranks())
    words = {b"word%d" % k for k in range(50)}
    trie.add(words)
    want = dict(trie.tokens)
    monkeypatch.setattr(token_counts, "MAX_STORED", 60)
    trie.add({b"other%d" % k for k in range(40)})
    assert len(trie.tokens) == 40
    trie.add(words)
    assert {w: trie.tokens[w] for w in words} == want


def test_bpe_round_trip(docs, no_docs):
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})

    def work(text):
        ids = plain.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        return [len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()]

    assert by_id(bpe.round_trip_digests(docs, RANKS), "n_tokens", "ids_sha256", "decoded_sha256") == expected(docs, work)
    back = bpe.decoded(bpe.encoded(docs, RANKS), RANKS)
    assert by_id(back, "bytes") == expected(docs, lambda t: [bytearray((t or "").encode())])
    assert bpe.round_trip_digests(no_docs, RANKS).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50])
def test_pieces_encode_as_the_whole(texts, size):
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    for text in texts:
        cut = list(bpe.pieces(text or "", size))
        assert "".join(p for p, _ in cut) == (text or "")
        assert [i for p, _ in cut for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text or "")


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "\t\u3000 \r\n" * 400_000, " " * bpe.LONG_RUN, "\x85" * (bpe.LONG_RUN - 1)])
def test_white_space_of_any_length(run):
    """Runs at the beginning, inside and at the end give the ids of the pattern's matches, each encoded alone."""
    own, plain = bpe.codec(RANKS), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    split = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    for text in (f"x{run}y", f"{run}x y", f"a word{run}", run, f"one{run}two {run}\n. {run}'s"):
        text += "" if len(text) > bpe.PIECE_CHARS else " filler" * bpe.PIECE_CHARS
        ids = own.encode(text)
        assert ids == [i for m in split.finditer(text) for i in plain._encode_single_piece(m[0])]
        assert own.decode(ids) == text.encode()


def thue_morse(n):
    """A word of 2^n letters and its complement: every polynomial hash modulo 2^64 takes them for equal, from some length on."""
    word, other = "a", "b"
    for _ in range(n):
        word, other = word + other, other + word
    return word, other


def test_long_equal_hashes_do_not_make_repeats(spark):
    one, two = thue_morse(12)
    lines, words = f"{one}\n{two}\n{one}", f"{one} b x {two} b x"
    found = quality_rules.measured(spark.createDataFrame([(1, f"{one}\n{two}"), (2, lines), (3, words), (4, words + " " + words)], "doc_id long, text string"), "doc_id")
    counts = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in found.collect()}
    assert counts == {k: tuple(rule_counts(t)[3:]) for k, t in ((1, f"{one}\n{two}"), (2, lines), (3, words), (4, words + " " + words))}


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_quality_rules(docs, no_docs):
    def work(text):
        counts = rule_counts(text)
        return [*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]]

    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_id(quality_rules.judged(docs), *columns) == expected(docs, work)
    assert quality_rules.judged(no_docs).count() == 0
    assert quality_rules.kept_documents(no_docs).count() == 0


def test_host_verdicts(spark):
    good = [("good", False)] * 95 + [("good", True)] * 5
    rows = good + [("bad", True)] * 90 + [("bad", False)] * 10 + [("new", True)] + [(None, False)] * 3 + [("mid", False)] * 60 + [("mid", True)] * 40
    hosts = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert {h for h, r in hosts.items() if r.host_rejected} >= {"bad"} and not hosts["good"].host_rejected and not hosts["mid"].host_rejected
    assert 0.4 < hosts["new"].rate < 0.9  # one document says little
    assert hosts[None].n_documents == 3


def test_rejected_hosts_lose_their_documents(spark):
    good, bad = " ".join(f"word{k}" for k in range(60)), "short"
    rows = [(k, good, "a") for k in range(40)] + [(100 + k, bad, "b") for k in range(40)] + [(999, good, "b"), (1000, good, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = quality_rules.kept_documents(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {*range(40), 1000}
    assert {r.doc_id for r in quality_rules.judged(frame).filter("kept").collect()} == {*range(40), 1000}


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 3000])
def test_decontamination(spark, docs, texts, no_docs, block_bytes):
    items = [(1, texts[0][:300].upper()), (2, "word"), (3, texts[4]), (3, texts[4]), (4, None), (5, ""), (None, "one two three four"), (10, "--- ,"), (11, "same same same")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for name, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if name is None else str(name))
    lengths = {len(w) for w in windows}

    def work(text):
        w, hit, names = fold(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        return [len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)]

    found = decontamination.judged(docs, benchmark, block_bytes)
    assert by_id(found, "n_words", "n_hit", "items", "contaminated") == expected(docs, work)
    for r in found.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        covered = [w for a, b in zip(r.spans[::2], r.spans[1::2], strict=True) for w in fold(r.text[a:b])]
        assert len(covered) == r.n_hit
    kept = decontamination.clean_documents(docs, benchmark, block_bytes)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in expected(docs, work) if not r[4])
    assert decontamination.judged(no_docs, benchmark).count() == 0
    assert decontamination.judged(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_compression_quality(spark, docs, no_docs):
    good = [f"the river of words number {k} flows along the valley and the village near the mill {k % 7}" * 3 for k in range(200)]
    bad = [f"{k} | $$$ | buy!! | {k * 7} | *** | cheap!! | %%% |" * 4 for k in range(200)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 200), None) for k in range(400)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    held = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    model = compression_quality.fit(table, labels.filter(~labels.doc_id.isin(held)))
    scores = {r.doc_id: r.score for r in compression_quality.scored(table, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert sum((scores[k] >= 0.5) == (k < 200) for k in held) >= 0.95 * len(held)
    assert compression_quality.scored(docs, model).filter("score is null").count() == 0
    assert compression_quality.scored(no_docs, model).count() == 0
    bare = compression_quality.fit(table, labels.limit(0))
    assert {r.score for r in compression_quality.scored(docs, bare).collect()} == {0.5}
    one_sided = compression_quality.fit(table, labels.filter("quality = 1"))
    assert all(r.score > 0.9 for r in compression_quality.scored(docs, one_sided).collect())
