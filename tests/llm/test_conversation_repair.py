"""Conversation repair against an enumeration of edits, a plain shortest path, and with pages of a few turns."""

import hashlib
import itertools
import random
import re

import pytest

from terraloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, page long, edges string, fault int, audit string, some string, n string, c long, `first` long"
EXTRA = (1, "x", 9, "x", "x", "x", 1, 1)


def faults(rows):
    """Rows as (turn, role, text) in order, with the number of each one's first fault."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out = []
    for k, (_, role, text) in enumerate(rows):
        left = re.findall(r"[^\x20\x09-\x0D]", text)
        if not left:
            out.append(cr.BLANK)
        elif (role, text) in [(r, x) for _, r, x in rows[:k]]:
            out.append(cr.DUPLICATE)
        else:
            out.append(cr.SOUND if left[-1] in ".!?" else cr.TRUNCATED)
    return rows, out


def plain(rows):
    """All columns of an audit, by a recursion that keeps whole strings."""
    rows, own = faults(rows)

    def insert(state, v):
        cost, audit, lines = v[cr.NEXT[state]]
        return cost + 5, "I" + audit, (cr.DUE[state] + ":",) + lines

    end = {0: (0, "", ()), 3: (0, "", ())}
    end[2] = (5, "I", ("assistant:",))
    end[1] = (10, "II", ("user:", "assistant:"))
    v = end
    for (_, role, text), fault in zip(reversed(rows), reversed(own), strict=True):
        more, new = 5 * (fault == cr.TRUNCATED), {}
        for state in range(4):
            options = [(v[state][0] + 2, "D" + v[state][1], v[state][2])]
            if fault not in (cr.BLANK, cr.DUPLICATE):
                due, to = cr.DUE[state], cr.NEXT[state]
                if role[:1] == due[0]:
                    options.append((v[to][0] + more, "K" + v[to][1], (f"{role}:{text}",) + v[to][2]))
                else:
                    options.append((v[to][0] + more + 1, "R" + v[to][1], (f"{due}:{text}",) + v[to][2]))
                if state == 0 and role[:1] == "s":
                    options.append((v[1][0] + more, "K" + v[1][1], (f"{role}:{text}",) + v[1][2]))
            new[state] = min(options)
        for state in (2, 3, 2, 0, 1):
            new[state] = min(new[state], insert(state, new))
        v = new
    cost, audit, lines = v[0]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] or "\0" for _, r, _ in rows]
    return [
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        own.count(cr.BLANK),
        own.count(cr.DUPLICATE),
        own.count(cr.TRUNCATED),
        sum(a + b not in cr.LEGAL for a, b in itertools.pairwise(initials)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    ]


def enumerated(turns):
    """The least cost and its least edits, from all edit sequences with up to three inserts."""
    best = None
    rows = [["D"] if f in (cr.BLANK, cr.DUPLICATE) else ["D", "K", "Ru", "Ra"] for _, f in turns]
    gaps = [g for n in range(3) for g in itertools.product(["Iu", "Ia"], repeat=n)]
    for own in itertools.product(*rows):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            if sum(map(len, inserts)) > 3:
                continue
            sequence = list(inserts[0])
            for edit, more in zip(enumerate(own), inserts[1:], strict=True):
                sequence += [edit, *more]
            initials, cost, audit = "", 0, ""
            for edit in sequence:
                if isinstance(edit, str):
                    initials, cost, audit = initials + edit[1], cost + 5, audit + "I"
                    continue
                (role, fault), edit = turns[edit[0]], edit[1]
                audit += edit[0]
                cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + 5 * (fault == cr.TRUNCATED and edit != "D")
                initials += {"D": "", "K": role[:1]}.get(edit, edit[-1])
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_edits_against_all_sequences():
    rng = random.Random(3)
    for n in (1, 2, 3):
        for _ in range(8):
            turns = [(rng.choice(["user", "assistant", "system", "tool"]), rng.randrange(4)) for _ in range(n)]
            audit, _ = cr.edits(turns, cr.AT_END, 0, True)
            assert (cr.cost_of(turns, audit), audit) == enumerated(turns), turns


def make_conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 3, 8, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None])
            text = rng.choice(["Hello.", "yes", "no!", "", " \n", None, "What now?", f"text {turn}.", f"cut {turn}", "Straße…", "\x00."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [(None, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(5)]
    rows += [(77, 0, "user", "same.")] * 50 + [(78, None, "user", f"n{k}") for k in range(9)]
    rows += rows[3:6]
    rows.append((79, 1, "user", "long " * 300_000 + "."))
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def expected(rows):
    of = {}
    for conv, *row in rows:
        of.setdefault(conv, []).append(row)
    return in_order([conv, *plain(own)] for conv, own in of.items())


@pytest.mark.parametrize("page_rows", [3, cr.PAGE_ROWS])
def test_audits(spark, page_rows):
    rows = make_conversations()
    turns = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    repair = cr.Repair(turns, of=turns, page_rows=page_rows)
    found = repair.audits()
    assert found.columns == COLUMNS
    assert in_order(list(r) for r in found.collect()) == expected(rows)
    # The repaired turns give the same digests.
    lines = {}
    for r in sorted(repair.turns().collect(), key=lambda r: r.place):
        own = lines.setdefault(r.conv_id, ([], []))
        own[0].append(r.edit)
        if r.role is not None:
            own[1].append(f"{r.role}:{r.text}")
    by_conv = {r[0]: r for r in expected(rows)}
    for conv, (audit, own) in lines.items():
        assert "".join(audit) == by_conv[conv][7]
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == by_conv[conv][8]


def test_one_long_conversation(spark):
    """One conversation over many pages and tasks, with many equal turns."""
    rng = random.Random(8)
    rows = [(5, None if k % 9 == 0 else k // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", f"{k}."])) for k in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert [list(r) for r in cr.Repair(turns, page_rows=64).audits().collect()] == expected(rows)


def test_conversations_without_turns(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert cr.Repair(turns).audits().count() == 0 and cr.Repair(turns).turns().count() == 0
    named = spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")
    nothing = [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    assert in_order(list(r) for r in cr.Repair(turns, of=named).audits().collect()) == [[None, *nothing], [4, *nothing]]


def test_damage(spark):
    """Nulls are one space in keys, roles and texts."""
    import zlib

    rows = [(None if k % 7 == 0 else k, None if k % 5 == 0 else k % 3, None if k % 11 == 0 else "assistant", None if k % 3 == 0 else "Is. it! so?") for k in range(200)]
    found = cr.damaged(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA))
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
