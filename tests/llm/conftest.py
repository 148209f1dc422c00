import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Columns whose names clash with computed ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, n_words long, ids string, block string, k1 string, score string, kept boolean, spans string"


def make_texts(seed=5, n=60):
    """Texts with copies, near copies, shared passages, odd white space, other scripts, and edge cases."""
    rng = random.Random(seed)
    vocabulary = ["th", "an", "er", "straße", "été", "naïve", "日本語", "word", "token", "x", "42", "a#b", "don't", "end.", "<i>"]
    words = [rng.choice(vocabulary) + rng.choice(vocabulary) + rng.choice(["", "", "s", "ing"]) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        if k % 4 == 0:
            at = rng.randrange(len(body))
            body[at:at] = passage.split()
        text = ""
        for w in body:
            text += w + rng.choice([" ", " ", " ", " ", "\n", "  ", " \n", "\t", ", ", " "])
        texts.append(text)
    texts += texts[:6]
    for k in range(8):  # near copies
        w = texts[k * 2].split(" ")
        if len(w) > 3:
            w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, None, "", "", " ", "\n\n", "one", "one two three four", "é", "a" * 500, "ab" * 300, " ".join(["same"] * 300), "\x00 nul \x00", "﻿bom"]
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents in no order, with a null id and a wholly repeated row."""
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), 7, 7, 7, "x", "x", "x", "x", True, "x") for k, t in enumerate(texts)]
    rows.append((None, "a text without an id " * 5, None, None, None, None, None, None, None, None, None, None, None, None))
    rows.append(rows[3])
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    """Rows as (doc_id, *columns), sorted with None first."""
    return sorted(([r[c] for c in ("doc_id", *columns)] for r in df.collect()), key=lambda r: (r[0] is not None, r))
