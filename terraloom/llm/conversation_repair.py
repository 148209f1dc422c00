"""Repair of the structure of conversations by a checkpointed shortest path over edits.

The turns of a conversation are edited until their roles' initials read ``(s?(ua)+)?``: a turn is kept (cost 0), given
the role that is due (1), deleted (2; blank and duplicate turns have to go), or an empty turn is inserted (5); a
truncated turn that stays costs 5 more. Of the cheapest edits those with the ASCII-least initials ``D I K R`` are taken.

Four states say what the turns so far end with, and every edit leads from a state to one other. The costs to go from
each state are worked out backwards, and stored only every square root of the length; walking forwards, the vectors
between two checkpoints are worked out anew and the least letter whose edit is tight is taken.

The same idea carries a conversation of any length over many tasks. Turns are sorted by conversation and packed into
pages of bounded size. A conversation within one page is repaired there. One that runs over several pages gives for
each page the cost from every state to every other; these small matrices make the vector at each page's end (the
checkpoints), then each page says in which state it ends for each state it begins in, and at last all pages emit their
edits at once. Only what a digest of a whole conversation needs is read in order, page by page, in constant memory.

Defined results: a null role or text is one space; rows come by turn (nulls first), then role, text and order of reading;
a role's initial is its first character, and an empty role has one that fits nowhere; a null conv_id is a conversation
of its own; repeated rows are duplicates; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.text import bounded
from terraloom.session import cut_lineage

USER, ASSISTANT = "user", "assistant"
#: Costs of the edits, and of a truncated turn that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's. What is due in each and where it leads.
DUE = (USER, USER, ASSISTANT, USER)
NEXT = (2, 2, 3, 2)
FAR = 1 << 60
#: Faults of a turn; the first one counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Turns and bytes of text in a page.
PAGE_ROWS, PAGE_BYTES = 1 << 16, 4 << 20
LEGAL = {"su", "ua", "au"}

_WORDED = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with about a quarter of the turns damaged, as their keys say: dropped, emptied, without
    sentence ends, repeated, or turned into the user's."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text[2].alias("role"), text[3].alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, USER).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies).drop("_copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, row`` (a number) and the first ``fault`` of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    # Written once: what tells equal rows apart must not change between two scans.
    rows = cut_lineage(rows.select("*", F.monotonically_increasing_id().alias("row"), key.alias("key"), (~F.col("text").rlike(_WORDED)).alias("blank")))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "row")
    again = rows.filter("not blank").groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = again.filter("n > 1").select("c", "k", "first.row").withColumnRenamed("row", "first")
    joined = rows.join(again, rows["conv_id"].eqNullSafe(again["c"]) & (rows["key"] == again["k"]), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") != F.col("row"), DUPLICATE)
    fault = fault.when(~F.col("text").rlike(_ENDED), TRUNCATED).otherwise(SOUND)
    return joined.select("conv_id", "turn", "role", "text", "row", fault.cast("int").alias("fault"))


# The shortest path of one stretch of turns. A turn is (role, fault); vectors hold the cost to go from each state.


def with_inserts(v: list[int]) -> list[int]:
    """The costs to go when turns may be inserted first."""
    two, three = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return [min(v[0], two + INSERT), min(v[1], two + INSERT), two, three]


#: What remains at the end of a conversation.
AT_END = with_inserts([0, FAR, FAR, 0])


def before(v: list[int], initial: str, fault: int) -> list[int]:
    """The costs to go from before a turn, by those from behind it."""
    if fault in (BLANK, DUPLICATE):
        return with_inserts([c + DELETE for c in v])
    more = TRUNCATED_STAYS if fault == TRUNCATED else 0
    user, assistant = v[2] + more + (initial != "u") * REROLE, v[3] + more + (initial != "a") * REROLE
    first = min(v[0] + DELETE, user, v[1] + more) if initial == "s" else min(v[0] + DELETE, user)
    return with_inserts([first, min(v[1] + DELETE, user), min(v[2] + DELETE, assistant), min(v[3] + DELETE, user)])


def matrix(turns: list[tuple[str, int]]) -> list[int]:
    """The least cost from each state before the turns to each state behind them, row by row; inserts behind the last turn are left out."""
    columns = []
    for end in range(4):
        v = [0 if s == end else FAR for s in range(4)]
        for role, fault in reversed(turns):
            v = before(v, role[:1], fault)
        columns.append(v)
    return [min(columns[end][s], FAR) for s in range(4) for end in range(4)]


def through(costs: list[int], v: list[int]) -> list[int]:
    """The vector before a page, by its matrix and the vector behind it."""
    return [min(min(costs[4 * s + e] + v[e] for e in range(4)), FAR) for s in range(4)]


def edits(turns: list[tuple[str, int]], end: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least tight edits of a stretch from ``state`` on, and the state behind it; ``end``: the costs to go
    behind the stretch; ``last``: the conversation ends there."""
    n = len(turns)
    step = max(1, math.isqrt(n))
    stored, v = {n: end}, end
    for i in range(n - 1, -1, -1):
        v = before(v, turns[i][0][:1], turns[i][1])
        if i % step == 0:
            stored[i] = v
    out: list[str] = []
    for start in range(0, n, step):
        stop = min(start + step, n)
        vectors = [stored[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(before(vectors[-1], turns[i][0][:1], turns[i][1]))
        vectors.reverse()
        for i in range(start, stop):
            state = _through_turn(out, vectors[i - start], vectors[i - start + 1], turns[i], state)
    while last and state not in (0, 3):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def _through_turn(out: list[str], own: list[int], behind: list[int], turn: tuple[str, int], state: int) -> int:
    initial, fault = turn[0][:1], turn[1]
    more = TRUNCATED_STAYS if fault == TRUNCATED else 0
    while True:
        cost = own[state]
        if cost == behind[state] + DELETE:
            out.append("D")
            return state
        if cost == own[NEXT[state]] + INSERT:
            out.append("I")
            state = NEXT[state]
            continue
        kept = 1 if initial == "s" and state == 0 else NEXT[state] if initial == DUE[state][0] else None
        if kept is not None and cost == behind[kept] + more:
            out.append("K")
            return kept
        out.append("R")
        return NEXT[state]


def applied(turns: list[tuple[str, int]], audit: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """Each edit with the number of its turn (none: inserted) and the role that it leaves (none: deleted)."""
    at = 0
    for letter in audit:
        due = DUE[state]
        if letter == "I":
            yield letter, None, due
            state = NEXT[state]
            continue
        role = turns[at][0]
        if letter == "D":
            yield letter, at, None
        elif letter == "K":
            yield letter, at, role
            state = 1 if state == 0 and role[:1] == "s" else NEXT[state]
        else:
            yield letter, at, due
            state = NEXT[state]
        at += 1


def cost_of(turns: list[tuple[str, int]], audit: str) -> int:
    own, at = 0, 0
    for letter in audit:
        own += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[letter]
        if letter != "I":
            own += TRUNCATED_STAYS * (turns[at][1] == TRUNCATED and letter != "D")
            at += 1
    return own


# Pages


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _opened(content: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(content)) as reader:
        return reader.read_all()


def _stretches(table: pa.Table) -> Iterator[tuple[object, int, int]]:
    """Conversation, start and end of each run of equal conversations."""
    names = table.column("conv_id").to_pylist()
    start = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[start]:
            yield names[start], start, i
            start = i


def _turns(table: pa.Table) -> list[tuple[str, int]]:
    """Roles and faults; a marker row, which keeps an empty conversation, has no role and is no turn."""
    roles, faults = table.column("role").to_pylist(), table.column("fault").to_pylist()
    return [(r, f) for r, f in zip(roles, faults, strict=True) if r is not None]


SUMMARY = "blank long, duplicate long, truncated long, illegal long, n_turns long, least long, most long, initials string"


def _summary(table: pa.Table) -> dict:
    """What the whole conversation's counts are made of; ``initials``: of the first and the last turn."""
    turns, numbers = _turns(table), [t for t in table.column("turn").to_pylist() if t is not None]
    faults = [f for _, f in turns]
    initials = [r[:1] or "\0" for r, _ in turns]
    return {
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),  # noqa: B905
        "n_turns": len(set(numbers)),
        "least": min(numbers, default=None),
        "most": max(numbers, default=None),
        "initials": initials[0] + initials[-1] if initials else "",
    }


def _added(one: dict, two: dict) -> dict:
    """The summary of two stretches that follow each other in the order of turns."""
    out = {k: one[k] + two[k] for k in ("blank", "duplicate", "truncated", "illegal", "n_turns")}
    if one["initials"] and two["initials"]:
        out["illegal"] += one["initials"][-1] + two["initials"][0] not in LEGAL
    out["n_turns"] -= one["most"] is not None and one["most"] == two["least"]
    out["least"] = two["least"] if one["least"] is None else one["least"]
    out["most"] = one["most"] if two["most"] is None else two["most"]
    out["initials"] = (one["initials"] or two["initials"])[:1] + (two["initials"] or one["initials"])[-1:]
    return out


class Repair:
    """The repair of all conversations of ``turns`` (``conv_id, turn, role, text``); ``of``: a frame whose ``conv_id``
    values all get a result, also those without a turn."""

    def __init__(self, turns: DataFrame, of: DataFrame | None = None, page_rows: int = PAGE_ROWS):
        self._kind = turns.schema["conv_id"].dataType.simpleString()
        rows = with_faults(turns).withColumn("some", F.lit(True))
        if of is not None:
            marks = of.select("conv_id").distinct()
            rows = rows.unionByName(marks.withColumn("some", F.lit(False)), allowMissingColumns=True)
        parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col(c).asc_nulls_first() for c in ("conv_id", "some", "turn", "role", "text", "row")]
        ordered = bounded(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
        edge = f"array<struct<conv_id {self._kind}, costs array<long>>>"
        self._pages = cut_lineage(ordered.mapInArrow(_to_pages(page_rows), f"page long, edges {edge}, content binary"))
        self._plan = cut_lineage(self._planned())

    def _planned(self) -> DataFrame:
        """Of each page that takes part in a longer conversation: ``page`` and ``parts``, at most two, with the costs to
        go behind the page, the state before it, and whether the conversation ends with it."""
        edges = self._pages.select("page", F.explode("edges").alias("e")).select("page", "e.conv_id", "e.costs")
        long = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
        edges = cut_lineage(edges.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))
        part = f"page long, conv_id {self._kind}, behind array<long>, last boolean"
        vectors = cut_lineage(edges.groupBy("conv_id").applyInArrow(_vectors, part))
        ends = self._with_pages(vectors).mapInArrow(_end_states, f"{part}, ends array<int>")
        return ends.groupBy("conv_id").applyInArrow(_entered, f"{part}, state int")

    def _with_pages(self, parts: DataFrame) -> DataFrame:
        """The pages of ``parts`` with their parts as a list; a page has at most two."""
        of_page = parts.groupBy("page").agg(F.collect_list(F.struct(*parts.columns)).alias("parts"))
        return bounded(self._pages).join(of_page, "page").select("page", "content", "parts")

    def _emitted(self, work, schema: str) -> DataFrame:
        pages = self._with_pages(self._plan)
        alone = bounded(self._pages).join(self._plan.select("page").distinct(), "page", "left_anti").select("page", "content")
        alone = alone.withColumn("parts", F.lit(None).cast(pages.schema["parts"].dataType))
        return pages.unionByName(alone).mapInArrow(work, schema)

    def turns(self) -> DataFrame:
        """Every edit in place: ``conv_id``, ``place`` (ascending within the conversation), ``edit``, and the ``turn``,
        ``role`` and ``text`` after it; a deleted turn has no role."""
        return self._emitted(_edited, f"conv_id {self._kind}, place long, edit string, turn long, role string, text string")

    def audits(self) -> DataFrame:
        """Per conversation the counts of its faults, ``gaps``, ``illegal`` neighbours, ``cost``, ``audit`` (the edits'
        initials) and ``repaired_sha256`` of its repaired lines."""
        stretch = f"conv_id {self._kind}, page long, whole boolean, cost long, audit string, repaired binary, {SUMMARY}"
        found = cut_lineage(self._emitted(_audited, stretch))
        parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Whole conversations carry their digest; pieces of longer ones are read in order.
        pieces = found.filter("not whole").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "page")
        final = f"conv_id {self._kind}, cost long, audit string, repaired binary, {SUMMARY}"
        joined = pieces.mapInArrow(_joined_pieces, final).unionByName(found.filter("whole").drop("page", "whole"))
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
        return joined.select(
            "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lower(F.hex("repaired")).alias("repaired_sha256")
        )


def _to_pages(page_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, rows, size = TaskContext.get().partitionId() << 20, [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, min(1024, page_rows - rows))
                held.append(piece)
                at, rows, size = at + piece.num_rows, rows + piece.num_rows, size + piece.nbytes
                if rows >= page_rows or size >= PAGE_BYTES:
                    yield _page(page, held)
                    page, held, rows, size = page + 1, [], 0, 0
        if held:
            yield _page(page, held)

    return run


def _page(page: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    found = list(_stretches(table))
    ends = [found[0]] if len(found) == 1 else [found[0], found[-1]]
    edges = [{"conv_id": name, "costs": matrix(_turns(table.slice(a, b - a)))} for name, a, b in ends]
    kind = pa.list_(pa.struct([("conv_id", table.schema.field("conv_id").type), ("costs", pa.list_(pa.int64()))]))
    columns = [pa.array([page], pa.int64()), pa.array([edges], kind), pa.array([_packed(table)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["page", "edges", "content"])


def _vectors(group: pa.Table) -> pa.Table:
    """The costs to go behind each page of one conversation: a few numbers a page."""
    group = group.sort_by("page")
    v, behind = AT_END, []
    for costs in reversed(group.column("costs").to_pylist()):
        behind.append(v)
        v = through(costs, v)
    behind.reverse()
    last = [False] * (group.num_rows - 1) + [True]
    columns = [group.column("page"), group.column("conv_id"), pa.array(behind, pa.list_(pa.int64())), pa.array(last)]
    return pa.Table.from_arrays(columns, names=["page", "conv_id", "behind", "last"])


def _end_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of pages with the state that each of the four states ends in."""
    for batch in batches:
        out, kind = [], batch.schema.field("parts").type.value_type.field("conv_id").type
        for content, parts in zip(batch.column("content").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            table = _opened(content)
            stretches = {name: (a, b) for name, a, b in _stretches(table)}
            for part in parts:
                a, b = stretches[part["conv_id"]]
                turns = _turns(table.slice(a, b - a))
                out.append(part | {"ends": [edits(turns, part["behind"], state, False)[1] for state in range(4)]})
        fields = {"page": pa.int64(), "conv_id": kind, "behind": pa.list_(pa.int64()), "last": pa.bool_(), "ends": pa.list_(pa.int32())}
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in fields.items()], names=list(fields))


def _entered(group: pa.Table) -> pa.Table:
    """The state before each page of one conversation."""
    group = group.sort_by("page")
    state, states = 0, []
    for ends in group.column("ends").to_pylist():
        states.append(state)
        state = ends[state]
    return group.drop_columns("ends").append_column("state", pa.array(states, pa.int32()))


def _repaired(batch: pa.RecordBatch) -> Iterator[tuple[int, dict | None, object, pa.Table, list, str, int]]:
    """Every stretch of a batch of pages: page, part (none: whole), conversation, rows, turns, audit and the state before it."""
    columns = (batch.column(c).to_pylist() for c in ("page", "content", "parts"))
    for page, content, parts in zip(*columns, strict=True):
        table = _opened(content)
        of = {p["conv_id"]: p for p in parts or ()}
        for name, a, b in _stretches(table):
            rows, part = table.slice(a, b - a), of.get(name)
            turns = _turns(rows)
            state = part["state"] if part else 0
            audit, _ = edits(turns, part["behind"] if part else AT_END, state, part["last"] if part else True)
            yield page, part, name, rows, turns, audit, state


def _real(rows: pa.Table) -> list[dict]:
    return [r for r in rows.select(["turn", "text", "role"]).to_pylist() if r["role"] is not None]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.schema.field("parts").type.value_type.field("conv_id").type
        fields = {"conv_id": kind, "place": pa.int64(), "edit": pa.string(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
        at, last = 0, None
        for page, _, name, rows, turns, audit, state in _repaired(batch):
            at = at if page == last else 0
            last, own, out = page, _real(rows), []
            for letter, k, role in applied(turns, audit, state):
                text = "" if k is None else own[k]["text"]
                out.append((name, (page << 20) + at, letter, None if k is None else own[k]["turn"], role, text))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(fields.values())], names=list(fields))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with their counts and edits; ``repaired``: the digest of a whole conversation, or a piece's lines."""
    for batch in batches:
        out, kind = [], batch.schema.field("parts").type.value_type.field("conv_id").type
        for page, part, name, rows, turns, audit, state in _repaired(batch):
            own = _real(rows)
            lines = [f"{role}:{'' if k is None else own[k]['text']}" for _, k, role in applied(turns, audit, state) if role is not None]
            content = "\n".join(lines).encode()
            if part is None:
                content = hashlib.sha256(content).digest()
            elif lines:
                content = b"\n" + content
            row = {"conv_id": name, "page": page, "whole": part is None, "cost": cost_of(turns, audit), "audit": audit, "repaired": content}
            out.append(row | _summary(rows))
        yield _rows(out, kind, with_page=True)


def _rows(out: list[dict], kind: pa.DataType, with_page: bool) -> pa.RecordBatch:
    fields = {"conv_id": kind} | ({"page": pa.int64(), "whole": pa.bool_()} if with_page else {})
    fields |= {"cost": pa.int64(), "audit": pa.string(), "repaired": pa.binary()}
    fields |= {name: pa.string() if t == "string" else pa.int64() for name, t in (c.split() for c in SUMMARY.split(", "))}
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in fields.items()], names=list(fields))


def _joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as one row a conversation: running digest, running sums."""
    held, digest, audit, kind = None, None, [], None

    def done() -> pa.RecordBatch:
        return _rows([held | {"audit": "".join(audit), "repaired": digest.digest()}], kind, with_page=False)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if held is None or row["conv_id"] != held["conv_id"]:
                if held is not None:
                    yield done()
                held, digest, audit, started = row, hashlib.sha256(), [], False
            else:
                held = {"conv_id": row["conv_id"], "cost": held["cost"] + row["cost"]} | _added(held, row)
            audit.append(row["audit"])
            digest.update(row["repaired"] if started else row["repaired"][1:])
            started = started or bool(row["repaired"])
    if held is not None:
        yield done()
