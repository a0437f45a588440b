"""Repair of conversations by weighted finite-state composition.

Three machines meet: an acceptor of the turns of a conversation, a transducer of edits
(keep, rerole, delete, insert) and an acceptor of roles, ``(s?(ua)+)?``. Their composition
is never built: its states are (turn, role state), and the arcs of a state are made when
the turn is read. Turns are the topological order. Weights are pairs (cost, string of the
edits' initials); the least weight from a state to the end is what is kept.

From a state, no two arcs have one initial. So a tie of costs is told by the arcs' own
initials, and a turn needs no more than the best arc of each of its four states: its
policy. The first pass reads turns from the last to the first and writes policies; the
second reads them forward from the start state and follows them. Both hold one turn at a
time, however long the conversation is; only the edits' string grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Role states: nothing yet, after s, after u, after a; what each accepts and where that leads.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Roles that can be written, by initial.
WRITTEN = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, RAGGED = 0, 2, 3, 2, 1
FINE, TRUNCATED, BLANK, DUPLICATE, GONE = "fine", "truncated", "blank", "duplicate", "gone"
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
Arc = tuple[int, str, int]


def written(state: int) -> tuple[str, int]:
    """The initial that a state lets be written, by an insertion or a new role, and where it leads."""
    return next((x, to) for x, to in GRAMMAR[state].items() if x in WRITTEN)


def arcs(initial: str, fault: str, state: int) -> Iterator[Arc]:
    """Arcs that read a turn in a role state: (cost, edit, next state)."""
    yield DELETE, "D", state
    if fault not in (BLANK, DUPLICATE):
        ragged = RAGGED if fault == TRUNCATED else 0
        if initial in GRAMMAR[state]:
            yield KEEP + ragged, "K", GRAMMAR[state][initial]
        yield REROLE + ragged, "R", written(state)[1]


def closed(read: list[tuple[int, str]]) -> tuple[list[int], str]:
    """Costs and first edits of all states, where any number of turns may be inserted first.

    Insertions cost, so no best path comes back to a state by them: as many steps as
    there are states settle all.
    """
    best = list(read)
    for _ in GRAMMAR:
        best = [min(read[g], (INSERT + best[written(g)[1]][0], "I")) for g in range(len(GRAMMAR))]
    return [c for c, _ in best], "".join(e for _, e in best)


#: Costs from each state when no turn is left, and the first edits; E ends.
END, AT_END = closed([(0 if g in FINAL else NEVER, "E") for g in range(len(GRAMMAR))])


class Backward:
    """The composition read from its end: states are the costs that differ, made as they are met."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[tuple[int, ...], str]] = {}

    def step(self, costs: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], str]:
        """Costs before a turn, less their least, from those after it; and the turn's policy."""
        key = costs, initial if initial in ("s", "u", "a") else "", fault
        if key not in self.known:
            read = [min((c + costs[to], e) for c, e, to in arcs(initial, fault, g)) for g in range(len(GRAMMAR))]
            found, policy = closed(read)
            self.known[key] = tuple(c - min(found) for c in found), policy
        return self.known[key]


def _policies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the policy of each turn; turns come by conversation, last ones first."""
    machine, conversation, costs = Backward(), None, tuple(END)
    for batch in batches:
        out = []
        for k, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("k", "initial", "fault")), strict=True):
            if k != conversation:
                conversation, costs = k, tuple(END)
            policy = ""
            if fault != GONE:
                costs, policy = machine.step(costs, initial, fault)
            out.append(policy)
        yield batch.append_column("policy", pa.array(out, pa.string()))


class _Forward:
    """One conversation as it is followed: counts, edits, and the digest of what is written."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.state, self.cost, self.edits, self.wrote = conv_id, 0, 0, [], False
        self.digest, self.counts = hashlib.sha256(), dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.first = self.last = self.before = None
        self.distinct = self.illegal = 0

    def write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.wrote else "") + role + ":" + text).encode())
        self.wrote = True

    def insert(self, policy: str) -> None:
        while policy[self.state] == "I":
            initial, self.state = written(self.state)
            self.edits.append("I")
            self.cost += INSERT
            self.write(WRITTEN[initial], "")

    def read(self, turn: int | None, role: str, text: str, initial: str, fault: str, policy: str) -> None:
        if fault == GONE:
            return
        if fault != FINE:
            self.counts[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.insert(policy)
        edit = policy[self.state]
        self.edits.append(edit)
        cost, _, to = next(a for a in arcs(initial, fault, self.state) if a[1] == edit)
        if edit != "D":
            self.write(role if edit == "K" else WRITTEN[written(self.state)[0]], text)
        self.cost, self.state = self.cost + cost, to

    def end(self) -> tuple:
        self.insert(AT_END)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.edits), self.digest.hexdigest())


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; turns come by conversation, in order."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]
    now, at, done = None, None, []

    def rows() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("k", "conv_id", "turn", "role", "text", "initial", "fault", "policy"))
        for k, conv_id, *turn in zip(*columns, strict=True):
            if now is None or k != at:
                if now is not None:
                    done.append(now.end())
                now, at = _Forward(conv_id), k
            now.read(*turn)
        yield rows()
        done = []
    if now is not None:
        done.append(now.end())
    yield rows()


def _has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) != ""


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with the damage that the CRC-32 of 'conv_id:turn' tells.

    Of the remainder by 20: 0 drops a row (``gone``), 1 empties its text, 2 takes ``.!?``
    out of it, 3 repeats it, 4 makes its role user. Nulls are one space there and in texts.
    """

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    hurt = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds each turn's key, place (turn, digest), role initial and first fault.

    Blank: no character but ASCII blanks. Duplicate: its role and text stand earlier in
    the conversation. Truncated: the last such character is not one of ``.!?``. Texts
    that stand once in a conversation are counted away before any join.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    placed = turns.withColumns({"k": key, "seen": F.col("turn").isNotNull(), "digest": F.md5(F.concat_ws("\n", F.col("role"), F.col("text")))})
    here = F.struct("seen", "turn")
    firsts = placed.filter("NOT gone").groupBy("k", "role", "digest").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n"))
    again = firsts.filter("n > 1").drop("n")
    joined = placed.join(again, ["k", "role", "digest"], "left")
    # Equal rows of one turn are neighbours in this order: all but the first are duplicates.
    order = Window.partitionBy("k").orderBy("gone", "seen", "turn", "role", "digest")
    before = F.lag(F.struct("gone", "seen", "turn", "role", "digest")).over(order)
    twin = before.eqNullSafe(F.struct("gone", "seen", "turn", "role", "digest"))
    last = F.right(F.btrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(F.col("gone"), GONE)
        .when(~_has_word(F.col("text")), BLANK)
        .when(F.coalesce(here > F.col("first"), F.lit(False)) | twin, DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    return joined.withColumns({"fault": fault, "initial": F.substring("role", 1, 1)}).drop("first")


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of ``turns`` (conv_id, turn, role, text, gone).

    Rows that are ``gone`` only tell that a conversation exists. Turns stand by turn, nulls
    first; rows of one turn by role and then a digest of their text, whatever the engine's
    order. Repeated rows are duplicates. A null conv_id is a conversation of its own, a
    null role or text one space (no legal role, blank). Extra columns are left out. Each
    conversation is one row: counts of faults (each turn's first one), adjacent role
    initials that are not su, ua or au, the least cost, the edits' initials and the digest
    of the repaired turns. Of equal costs the least string of initials is taken. Without a
    turn left all is zero and empty.
    """
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    found = with_faults(turns.select("conv_id", "turn", *text, "gone"))
    names = ["k", "conv_id", "turn", "role", "text", "initial", "fault", "seen", "digest"]
    # The window's exchange has dealt the turns by conversation; each partition is read backward, then forward.
    dealt = found.select(*names).sortWithinPartitions("k", F.desc("seen"), F.desc("turn"), F.desc("role"), F.desc("digest"), F.asc("fault"))
    schema = dealt.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    told = dealt.mapInArrow(_policies, f"{schema}, policy string")
    forward = told.sortWithinPartitions("k", "seen", "turn", "role", "digest", F.desc("fault"))
    return forward.mapInArrow(_follow, RESULT)
