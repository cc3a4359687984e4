"""Operator 12: conversations repaired at the least cost, with an audit of the edits.

A conversation's rows are the layers of a graph: a node is a place between two rows and what the roles so far allow next,
an arc an edit at a small whole cost. Dial's bucket queue gives each node's distance to the end; a walk from the beginning along the
tight arcs, the least letter first, is the audit. Faults are marked by joins and counts. Each conversation's rows come
to one task, sorted, and pass it twice as a stream, backwards for the distances and forwards for the walk, with one Arrow batch
and four numbers in memory. One task it has to be: the contract wants one SHA-256 of the whole repaired conversation, and that
hash takes its input in order. Rows repeated outright are counted before they move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import slices, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SOUND, CUT, BLANK, DUPLICATE, GONE = range(5)  # of a row; GONE says that the conversation had one
#: What may follow: 0 nothing was kept yet, 1 after a system turn, 2 after a user's, 3 after an assistant's; 0 and 3 may end.
STATES, ENDS = range(4), (0, 3)
#: The state that a kept turn leads to, by its initial; and the role and state of the turn that fits where none of the rows does.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Distances to the end where no rows are left: insert what an open exchange lacks.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Distances of one layer differ by at most 10 and an arc costs at most 6, so 17 buckets in a ring never mix two distances.
BUCKETS = 17


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: ``rows`` as damaged by the CRC-32 of ``conv_id:turn``; n is how often a row is there then.

    Modulo 20: 0 drops it (n is 0), 1 empties the text, 2 takes out its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes the role user. Null role and text
    become one space, as do nulls in the key.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    role = F.when(kind == 4, "user").otherwise(some("role"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, fault, copy: a row for each of n of ``rows`` (as of ``damaged``), with its first fault.

    Blank has no sign but white space; duplicate has a role and text of an earlier row, by turn (null first), of rows with
    the same turn all but one; truncated doesn't end in ``.``, ``!`` or ``?``, white space aside. A conversation without rows left keeps one, GONE.
    """
    left = F.col("n") > 0
    kept = rows.select("conv_id", F.when(left, F.col("turn")).alias("turn"), F.when(left, F.col("role")).alias("role"), F.when(left, F.col("text")).alias("text"), "n")
    merged = written(kept.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.sha2("text", 256)), "conversation-rows")
    same = ["conv_id", "role", "digest"]
    first = F.min(F.struct("turn"))  # in a struct null is the least
    repeated = merged.where("role is not null").groupBy(*same).agg(first.alias("first"), F.count("*").alias("times")).where("times > 1").select(*[F.col(c).alias(f"{c}_") for c in same], "first")
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same]
    later = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(F.col("role").isNull(), GONE).when(bare == "", BLANK).when(later | (F.col("copy") > 0), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    each = merged.join(repeated, on[0] & on[1] & on[2], "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0).cast("long")))))
    return each.select("conv_id", "turn", "role", "text", "digest", fault.cast("int").alias("fault"), "copy")


def arcs(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row in a state, without the insertion before it; the least letter first."""
    out = [("D", DELETE, state)]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        if state in AFTER.get(initial, {}):
            out.append(("K", KEEP + more, AFTER[initial][state]))
        out.append(("R", REROLE + more, WANTED[state][1]))
    return out


_REVERSED: dict[tuple[str, int], list[list[tuple[int, int]]]] = {}


def _into(initial: str, fault: int) -> list[list[tuple[int, int]]]:
    """For each state behind a row the (state before it, cost) that lead there."""
    kind = (initial if initial in AFTER else "", fault)
    if kind not in _REVERSED:
        _REVERSED[kind] = [[(s, cost) for s in STATES for _, cost, to in arcs(*kind, s) if to == t] for t in STATES]
    return _REVERSED[kind]


_INSERTS = [[s for s in STATES if WANTED[s][1] == t] for t in STATES]


def dial(rows: list[tuple[str, int]], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Distances to the end of the conversation from each place before and between ``rows`` (initial, fault), by state.

    ``end`` has the distances behind the last of them; they are the first of the list that comes back, which runs backwards. Shortest paths
    over the arcs turned round, from a ring of buckets: a node is final once its bucket is emptied.
    """
    low = min(end)
    far = 1 << 60
    dist = [far] * (4 * (len(rows) + 1))
    ring: list[list[int]] = [[] for _ in range(BUCKETS)]
    for s in STATES:
        dist[s] = end[s] - low
        ring[dist[s]].append(s)
    layers = [_into(*r) for r in reversed(rows)]
    waiting, now = 4, 0
    while waiting:
        bucket = ring[now % BUCKETS]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue  # met again on a shorter way
            place, state = divmod(node, 4)
            for s in _INSERTS[state]:
                if now + INSERT < dist[4 * place + s]:
                    dist[4 * place + s] = now + INSERT
                    ring[(now + INSERT) % BUCKETS].append(4 * place + s)
                    waiting += 1
            if place < len(layers):
                for s, cost in layers[place][state]:
                    node = 4 * place + 4 + s
                    if now + cost < dist[node]:
                        dist[node] = now + cost
                        ring[(now + cost) % BUCKETS].append(node)
                        waiting += 1
        now += 1
    return [tuple(low + d for d in dist[k : k + 4]) for k in range(0, len(dist), 4)]


def _runs(conv: list) -> Iterator[tuple[object, int, int]]:
    at = 0
    for key, same in groupby(conv):
        n = sum(1 for _ in same)
        yield key, at, at + n
        at += n


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from its last to its first: the same with ``here``, the distances before each row, by state."""
    last, end = object(), AT_END
    for b in slices(batches, 4096):
        conv, fault = b.column("conv_id").to_pylist(), b.column("fault").to_pylist()
        initial = [(r or " ")[:1] for r in b.column("role").to_pylist()]
        here: list[tuple[int, ...]] = []
        for key, lo, hi in _runs(conv):
            if key != last:
                last, end = key, AT_END
            rows = [(initial[k], fault[k]) for k in range(hi - 1, lo - 1, -1) if fault[k] != GONE]
            found = dial(rows, end)
            here += found[1:] + [found[-1]] * (hi - lo - len(rows))
            end = found[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(here, pa.list_(pa.int64()))], schema=b.schema.append(pa.field("here", pa.list_(pa.int64()))))


class _Walk:
    """One conversation from its first row to its last: faults, gaps, the walk along tight arcs, and the hash of what it leaves."""

    def __init__(self) -> None:
        self.state, self.cost, self.waits = 0, 0, None
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.before = None
        self.turns, self.first = 0, True

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def inserted(self, here: tuple[int, ...]) -> bool:
        """Take the arc of an insertion if it is tight."""
        role, to = WANTED[self.state]
        if here[self.state] != INSERT + here[to]:
            return False
        self.audit.append("I")
        self.say(role, "")
        self.state = to
        return True

    def step(self, after: tuple[int, ...]) -> None:
        """The row that waits, now that the distances behind it are known."""
        role, text, fault, here = self.waits
        while True:
            tight = {letter: to for letter, cost, to in arcs(role[:1], fault, self.state) if here[self.state] == cost + after[to]}
            if "D" in tight:
                self.audit.append("D")
                return
            if not self.inserted(here):
                break
        letter = "K" if "K" in tight else "R"
        self.audit.append(letter)
        self.say(role if letter == "K" else WANTED[self.state][0], text)
        self.state = tight[letter]

    def row(self, turn: int | None, role: str, text: str, fault: int, here: tuple[int, ...]) -> None:
        if self.waits:
            self.step(here)
        else:
            self.cost = here[0]
        for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT)):
            self.counts[name] += fault == kind
        self.counts["illegal"] += self.waits is not None and self.before + role[:1] not in ("su", "ua", "au")
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.before, self.waits = role[:1], (role, text, fault, here)

    def close(self) -> dict:
        if self.waits:
            self.step(AT_END)
            while self.state not in ENDS:
                self.inserted(AT_END)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = [(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in RESULT.split(", ")]


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from its first to its last, with ``here``: a row for each conversation."""
    last, walk, keys, done, kind = object(), None, [], [], None

    def out() -> pa.RecordBatch:
        columns = [pa.array(keys, kind), *[pa.array([d[name] for d in done], t) for name, t in _RESULT]]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *[name for name, _ in _RESULT]])

    for b in slices(batches, 4096):
        kind = b.schema.field("conv_id").type
        columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "here")]
        for key, turn, role, text, fault, here in zip(*columns):
            if key != last or walk is None:
                if walk is not None:
                    keys.append(last)
                    done.append(walk.close())
                last, walk = key, _Walk()
            if fault != GONE:
                walk.row(turn, role, text, fault, tuple(here))
        if done:
            yield out()
            keys, done = [], []
    if walk is not None:
        keys, done = [last], [walk.close()]
        yield out()


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id and ``RESULT`` for each conversation of ``rows`` (conv_id, turn, role, text, n; as of ``damaged``).

    gaps, blank, duplicate, truncated and illegal count what is wrong with the rows by turn (null first, ties by role, then by the SHA-256 of
    the text); cost and audit are the cheapest edits (of those the ASCII-least) that leave the roles as ``(s?(ua)+)?``, and
    repaired_sha256 the hash of what they leave. Roles count by their first sign; an empty role fits nowhere. Conversations without rows left have zeros, an
    empty audit and the hash of the empty text; a null conv_id is a conversation; other columns are left behind.
    """
    order = ["conv_id", "turn", "role", "digest", "copy"]
    dealt = marked(rows).repartition("conv_id")
    back = dealt.sortWithinPartitions(*[F.col(c).desc() for c in order])
    known = back.mapInArrow(_distances, back.schema.simpleString()[7:-1] + ",here:array<bigint>")
    result = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}"
    return known.sortWithinPartitions(*order).mapInArrow(_walks, result)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged and repaired."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))
