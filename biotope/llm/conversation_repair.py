"""Repair of conversation structure by lightest derivations.

The turns of a conversation are edited until their role initials read ``(s?(ua)+)?``. An item says that so many rows
are used up and the roles so far end in a state of that grammar; its weight is (cost, audit), the audit being the
initials of its edits. Items are deduced from one another by edits (a keep, a new role or a deletion uses up a row, an
insertion none), and popped from an agenda in the order of their weights, as Knuth's algorithm does, until the goal
item is final. That needs weights that never fall along a deduction and keep their order under it:

* an item of equal cost that uses up fewer rows is popped first, since a keep may cost nothing;
* of two equally dear derivations of one item neither audit begins with the other, for the longer one would hold
  more insertions and cost more. So what is appended later never turns their order round.

A conversation is cut into segments of at most ``SEGMENT`` rows, solved from each state to each state in tasks of
their own; ``FAN`` neighbouring segments then combine by the same agenda, with segments in the place of rows, until
one is left. Repeated rows, turns and roles may thus fill a conversation of any length. Only the digest of a repaired
conversation is read by one task, row after row, as SHA-256 is a chain; that task holds the audit and one batch.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.session import materialize

SEGMENT, FAN = 512, 64
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an inserted or renamed turn takes in a state.
MISSING = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STATES, GOALS = range(4), (0, 3)
LEGAL = {"su", "ua", "au"}

Weight = tuple[int, str]


def lightest(start: int, length: int, edges: Callable[[int, int], Iterable[tuple[int, int, int, str]]]) -> dict[int, Weight]:
    """Weights of the items that use up all of ``length``, by end state, from one start state.

    ``edges(used, state)`` gives (used, state, cost, letters) of each deduction from an item.
    """
    agenda = [(0, 0, "", start)]
    final: set[tuple[int, int]] = set()
    goals: dict[int, Weight] = {}
    while agenda and len(goals) < len(STATES):
        cost, used, audit, state = heapq.heappop(agenda)
        if (used, state) in final:
            continue
        final.add((used, state))
        if used == length:
            goals[state] = cost, audit
        for used_next, state_next, more, letters in edges(used, state):
            if (used_next, state_next) not in final:
                heapq.heappush(agenda, (cost + more, used_next, audit + letters, state_next))
    return goals


def _table(length: int, edges) -> tuple[list, list]:
    """Costs and audits from each state to each state, by 4 * start + end; None where there is no way."""
    costs, audits = [None] * 16, [None] * 16
    for start in STATES:
        for end, (cost, audit) in lightest(start, length, edges).items():
            costs[4 * start + end], audits[4 * start + end] = cost, audit
    return costs, audits


def solve_rows(pattern: str) -> tuple[list, list]:
    """Table of a segment whose rows are written as two characters each: role initial and fault (b, d, t or -)."""
    rows = [(pattern[k], pattern[k + 1]) for k in range(0, len(pattern), 2)]

    def edges(used: int, state: int):
        yield used, NEXT[state, MISSING[state][0]], INSERT, "I"
        if used == len(rows):
            return
        initial, fault = rows[used]
        yield used + 1, state, DELETE, "D"
        if fault in "bd":
            return
        extra = TRUNCATED if fault == "t" else 0
        if (state, initial) in NEXT:
            yield used + 1, NEXT[state, initial], extra, "K"
        yield used + 1, NEXT[state, MISSING[state][0]], REROLE + extra, "R"

    return _table(len(rows), edges)


#: Short conversations repeat one another's patterns.
_remembered = lru_cache(maxsize=1 << 14)(solve_rows)


def solve_segments(tables: list[tuple[list, list]]) -> tuple[list, list]:
    """Table of neighbouring segments in order."""

    def edges(used: int, state: int):
        if used < len(tables):
            costs, audits = tables[used]
            for end in STATES:
                if costs[4 * state + end] is not None:
                    yield used + 1, end, costs[4 * state + end], audits[4 * state + end]

    return _table(len(tables), edges)


def illegal_pairs(initials: str) -> int:
    return sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))


TABLE = "pattern_ends string, illegal long, costs array<long>, audits array<string>"


def _solved(batches):
    """Per segment its outer initials, illegal neighbours and table."""
    for batch in batches:
        *own, patterns = batch.columns
        found = []
        for pattern in patterns.to_pylist():
            initials = pattern[::2]
            found.append((initials[0] + initials[-1], illegal_pairs(initials), *(_remembered if len(pattern) <= 64 else solve_rows)(pattern)))
        yield _record([*own], batch.schema.names[:-1], found)


def _record(own: list, names: list, found: list) -> pa.RecordBatch:
    ends, illegal, costs, audits = zip(*found, strict=True) if found else ([], [], [], [])
    columns = [pa.array(ends, pa.string()), pa.array(illegal, pa.int64()), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*own, *columns], [*names, "pattern_ends", "illegal", "costs", "audits"])


def _combined(batches):
    """Per group of neighbouring segments, given as a list in order, their common table."""
    for batch in batches:
        *own, groups = batch.columns
        found = []
        for group in groups.to_pylist():
            between = sum(a["pattern_ends"][1] + b["pattern_ends"][0] not in LEGAL for a, b in zip(group, group[1:], strict=False))
            tables = [(g["costs"], g["audits"]) for g in group]
            found.append((group[0]["pattern_ends"][0] + group[-1]["pattern_ends"][1], sum(g["illegal"] for g in group) + between, *(tables[0] if len(tables) == 1 else solve_segments(tables))))
        yield _record([*own], batch.schema.names[:-1], found)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults put in by crc32(``conv_id:turn``) modulo 20; nulls are one space there
    and in role and text. 0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats the row, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``seq``, a number that rises in the order of turn (nulls first), role and a hash of the text.

    Range partitions sorted within: a conversation of any size is spread. Rows equal in all columns are spread as well.
    """
    return materialize(
        rows.select("*", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("at"))
        .repartitionByRange("conv_id", "turn", "role", "text_hash", "at")
        .sortWithinPartitions("conv_id", "turn", "role", "text_hash", "at")
        .select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq")),
        "turns",
    )


def with_faults(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, initial, fault) of each row: ``b`` blank, ``d`` role and text seen earlier, ``t`` last
    character other than white space not one of ``.!?``, or ``-``; the first that applies counts."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    narrow = materialize(
        ordered.select(
            "conv_id", "turn", "seq", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
            (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
            F.when(body != "", F.md5(F.to_json(F.struct("conv_id", "role", "text")))).alias("said"),
        ),
        "narrow_turns",
    )
    first = narrow.where("not blank").groupBy("said").agg(F.min("seq").alias("first_seq")).select("first_seq")
    fault = F.when(F.col("blank"), "b").when(F.col("first_seq").isNull(), "d").when(F.col("truncated"), "t").otherwise("-")
    return narrow.join(first, F.col("seq") == F.col("first_seq"), "left").select("conv_id", "turn", "seq", "initial", fault.alias("fault"))


def lightest_repairs(faulty: DataFrame) -> DataFrame:
    """(conv_id, first_seq, illegal, cost, audit) of each conversation."""
    kind = faulty.schema["conv_id"].dataType.simpleString()
    bounded = F.array_sort(F.collect_list(F.struct("seq", "initial", "fault")))  # at most SEGMENT rows
    segments = (
        faulty.groupBy("conv_id", F.expr(f"seq div {SEGMENT}").alias("segment"))
        .agg(F.min("seq").alias("first_seq"), bounded.alias("rows"))
        .select("conv_id", "first_seq", F.array_join(F.transform("rows", lambda r: F.concat(r["initial"], r["fault"])), "").alias("pattern"))
    )
    solved = materialize(segments.mapInArrow(_solved, f"conv_id {kind}, first_seq long, {TABLE}"), "segments")
    while True:
        several = solved.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1")
        if several.isEmpty():
            break
        number = F.row_number().over(Window.partitionBy("conv_id").orderBy("first_seq"))  # a row per segment, not per turn
        parts = F.array_sort(F.collect_list(F.struct("first_seq", "pattern_ends", "illegal", "costs", "audits")))
        groups = (
            solved.withColumn("number", number).groupBy("conv_id", F.expr(f"(number - 1) div {FAN}").alias("part"))
            .agg(F.min("first_seq").alias("first_seq"), parts.alias("parts")).select("conv_id", "first_seq", "parts")
        )
        solved = materialize(groups.mapInArrow(_combined, f"conv_id {kind}, first_seq long, {TABLE}"), "segments")
    ways = F.array(*[F.struct(F.get("costs", F.lit(g)).alias("cost"), F.get("audits", F.lit(g)).alias("audit")) for g in GOALS])
    best = F.array_min(F.filter(ways, lambda w: w["cost"].isNotNull())).alias("best")
    return solved.select("conv_id", "first_seq", "illegal", best).select("conv_id", "first_seq", "illegal", "best.cost", "best.audit")


class Editor:
    """Applies an audit to the rows of one conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the insertions that come now."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role = MISSING[self.state]
            self.state = NEXT[self.state, role[0]]
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the insertions before the row and of the row itself, unless it is deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = MISSING[self.state] if edit == "R" else role
            self.state = NEXT[self.state, role[0]]
            yield edit, role, text


def _walked(batches) -> Iterator[tuple[pa.RecordBatch, int, list, bool]]:
    """(batch, row, edited lines, whether they end the conversation before this row) along sorted rows.

    The audit stands on the first row of a conversation. The end of the last one has batch None.
    """
    editor = None
    for batch in batches:
        roles, bodies, audits = (batch.column(c).to_pylist() for c in ("role", "text", "audit"))
        for k, (role, body, audit) in enumerate(zip(roles, bodies, audits, strict=True)):
            if audit is not None:
                if editor:
                    yield batch, k, list(editor.inserted()), True
                editor = Editor(audit)
            yield batch, k, list(editor.row(role, body)), False
    if editor:
        yield None, 0, list(editor.inserted()), True


def _digested(batches):
    """Conversation number and SHA-256 of the repaired ``role:text`` lines, in order; the text is never held whole."""
    digest, empty, first_seq = None, True, None
    out: list[tuple[int, str]] = []

    def add(lines):
        nonlocal empty
        for _, role, text in lines:
            digest.update(b"" if empty else b"\n")
            digest.update(role.encode() + b":" + text.encode())
            empty = False

    def record():
        columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["first_seq", "repaired_sha256"])

    for batch, k, lines, ends in _walked(batches):
        if ends:
            add(lines)
            out.append((first_seq, digest.hexdigest()))
            digest = None
            if len(out) >= 1000:
                yield record()
                out.clear()
            continue
        if digest is None:
            digest, empty, first_seq = hashlib.sha256(), True, batch.column("seq")[k].as_py()
        add(lines)
    if out:
        yield record()


def _edited(batches):
    """(first_seq, line, edit, role, text) of the repaired turns."""
    first_seq, line = None, 0
    out: list[tuple] = []

    def record():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["first_seq", "line", "edit", "role", "text"]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)

    for batch, k, lines, ends in _walked(batches):
        if not ends and batch.column("audit")[k].is_valid:
            first_seq, line = batch.column("seq")[k].as_py(), 0
        for edit, role, text in lines:
            out.append((first_seq, line, edit, role, text))
            line += 1
        if len(out) >= 1000:
            yield record()
            out.clear()
    if out:
        yield record()


def _along(ordered: DataFrame, repairs: DataFrame) -> DataFrame:
    """Rows by conversation in order, the first of each with its audit."""
    texts.settings(ordered.sparkSession)
    audits = repairs.select(F.col("first_seq").alias("seq"), "audit")
    return ordered.join(audits, "seq", "left").select("conv_id", "seq", "role", "text", "audit").repartition("conv_id").sortWithinPartitions("conv_id", "seq")


def repaired_turns(ordered: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, line, edit, role, text): the turns of the repaired conversations."""
    found = _along(ordered, repairs).mapInArrow(_edited, "first_seq long, line long, edit string, role string, text string")
    return found.join(repairs.select("conv_id", "first_seq"), "first_seq").select("conv_id", "line", "edit", "role", "text")


def repair_summary(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations`` on the faults and the lightest repair of its rows in ``damaged``.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Rows go by turn, nulls first,
    ties by role and a hash of the text; a null conv_id names a conversation of its own. Roles other than those that begin with s, u
    or a are never kept. ``gaps`` are the turn numbers left out between the smallest and the largest, 0 without any and
    null beyond the range of a long. A conversation without rows has zeros, an empty audit and the digest of nothing.
    Extra columns are ignored; an empty table gives an empty table.
    """
    ordered = in_order(damaged)
    faulty = materialize(with_faults(ordered), "faulty_turns")
    repairs = materialize(lightest_repairs(faulty), "repairs")
    digests = _along(ordered, repairs).mapInArrow(_digested, "first_seq long, repaired_sha256 string")
    of = lambda letter: F.sum((F.col("fault") == letter).cast("long"))
    by_turn = faulty.groupBy("conv_id", "turn").agg(F.min("seq").alias("seq"), of("b").alias("blank"), of("d").alias("duplicate"), of("t").alias("truncated"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce((F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count("turn")).try_cast("long"), F.when(F.count("turn") == 0, 0))
    counts = by_turn.groupBy("conv_id").agg(F.min("seq").alias("first_seq"), gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    found = repairs.select("first_seq", "illegal", "cost", "audit").join(counts.withColumnRenamed("conv_id", "conv"), "first_seq").join(digests, "first_seq")
    every = conversations.select("conv_id").distinct()
    zero = lambda c: F.when(F.col("first_seq").isNull(), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def repair(conversations: DataFrame) -> DataFrame:
    """Summary of the rows as they are, without damage; null roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return repair_summary(conversations, conversations.select("conv_id", "turn", space("role"), space("text")))
