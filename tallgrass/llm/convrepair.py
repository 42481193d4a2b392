"""Repair of the structure of conversations by cheapest edits.

A conversation is legal if the initials of its roles read (s?(ua)+)?: nothing, or an optional system turn and then pairs of user and assistant. Turns can be kept (0), given another role (2) or deleted (3),
and empty turns can be inserted (2); blank and duplicate turns must be deleted, and a truncated turn that stays adds 1. Among the cheapest edits the ASCII-least string of their initials is taken.

The edits come from a dynamic program over four states. Cost vectors are computed backwards, but only those at about the square root of n checkpoints are stored; a walk forward recomputes the vectors of a block
from its checkpoint and takes, turn by turn, the first edit in ASCII order that is tight.

Turns are sorted by ranges of (conversation, turn, role, digest of the text), so a conversation of any length is spread over tasks. A task repairs the conversations that lie inside it. Its first and its last one may go on in other
tasks: for these, at most two a task, the driver learns the 4 x 4 matrix of costs from state to state, and later the state in which each part ends, and hands each part its first state and the vector at its end. Texts
are not read until the edits are known, and only those of turns that stay are sorted.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import inf, isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir, table

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of each initial, where that is legal.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, LATE = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a piece of a repaired conversation that goes on in another task.
PIECE = 1 << 18


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _closed(v: tuple) -> tuple:
    """A vector of costs to the end, with turns inserted here where that is cheaper."""
    v = list(v)
    for state in (USER, ASSISTANT, START, SYSTEM, USER):
        v[state] = min(v[state], INSERT + v[_inserted(state)])
    return tuple(v)


END = _closed((0, inf, inf, 0))


@lru_cache(maxsize=1 << 14)
def _back(v: tuple, initial: str, late: bool) -> tuple:
    """The vector before a turn that needn't be deleted, from the one after it."""
    out = []
    for state in range(4):
        kept = STEP.get(initial, {}).get(state)
        to = _inserted(state)  # the only role that can follow by force is the one that could be inserted
        out.append(min(DELETE + v[state], late * LATE + v[kept] if kept is not None else inf, REROLE + late * LATE + v[to]))
    return _closed(tuple(out))


class Turns:
    """Part of a conversation: for each distinct turn its initial, whether it may stay and is late, and how many deletions are forced."""

    def __init__(self):
        self.initials, self.free, self.late, self.forced = [], bytearray(), bytearray(), array("q")

    def add(self, initial: str, free: bool, late: bool, forced: int) -> None:
        self.initials.append(initial if initial in STEP else "")
        self.free.append(free)
        self.late.append(late)
        self.forced.append(forced)

    def before(self, i: int, v: tuple) -> tuple:
        """The vector before turn i. Vectors are kept relative to their least entry, so that few differ and steps are remembered."""
        low = min(v)
        if self.free[i]:
            u = _back(tuple(x - low for x in v), self.initials[i], bool(self.late[i]))
            return tuple(x + low + DELETE * self.forced[i] for x in u)
        return tuple(x + DELETE * self.forced[i] for x in v)

    def start(self, end: tuple) -> tuple:
        for i in reversed(range(len(self.free))):
            end = self.before(i, end)
        return end

    def edits(self, state: int, end: tuple, last: bool) -> Iterator[tuple[int, str, str, int, int]]:
        """Walks forward: for each turn its number, the edits' initials, the initials of roles inserted before it, the role that it gets (START: it is deleted, -1: its own) and the state after it; at last what is inserted at the end."""
        n = len(self.free)
        width = isqrt(n) + 1
        marks = []
        v = end
        for at in reversed(range(0, n, width)):
            marks.append(v)
            for i in reversed(range(at, min(n, at + width))):
                v = self.before(i, v)
        for at in range(0, n, width):
            block = [marks.pop()]
            for i in reversed(range(at, min(n, at + width))):
                block.append(self.before(i, block[-1]))
            for i in range(at, min(n, at + width)):
                here, after = block.pop(), block[-1]
                forced = self.forced[i]
                if not self.free[i]:
                    yield i, "D" * forced, "", START, state
                    continue
                v = tuple(x + DELETE * forced for x in after)
                head, late = "", self.late[i] * LATE
                while True:
                    need, to, kept = here[state], _inserted(state), STEP.get(self.initials[i], {}).get(state)
                    if need == DELETE + v[state]:
                        yield i, "I" * len(head) + "D" * (1 + forced), head, START, state
                        break
                    if need == INSERT + here[to]:
                        head, state = head + ROLE[to][0], to
                        continue
                    keep = kept is not None and need == late + v[kept]
                    state = kept if keep else to
                    yield i, "I" * len(head) + ("K" if keep else "R") + "D" * forced, head, -1 if keep else to, state
                    break
        head = ""
        while last and END[state]:
            state = _inserted(state)
            head += ROLE[state][0]
        yield n, "I" * len(head), head, START, state


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, object, Turns, list[pa.RecordBatch]]]:
    """The conversations of a task in order: number, whether it is the task's last, id, turns and the rows' keys. Only one is held, as codes and Arrow columns."""
    number, held = 0, None
    for b in batches:
        ids = b.column("conv").to_pylist()
        initial, n, blank, late, seen = (b.column(c).to_pylist() for c in ("initial", "n", "blank", "late", "seen"))
        at = 0
        for conv, group in groupby(ids):
            size = sum(1 for _ in group)
            if held is None or held[0] != conv:
                if held is not None:
                    yield number, False, *held
                    number += 1
                held = conv, Turns(), []
            for i in range(at, at + size):
                free = not (blank[i] or seen[i])
                held[1].add(initial[i], free, late[i], n[i] - free)
            held[2].append(b.slice(at, size))
            at += size
    if held is not None:
        yield number, True, *held


_BASIS = [_closed(tuple(0 if s == t else inf for s in range(4))) for t in range(4)]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first and the last conversation of a task: matrix of costs (-1: impossible), and the rows' first and last initials."""
    me = TaskContext.get().partitionId()
    for number, last, conv, turns, rows in _parts(batches):
        if number == 0 or last:
            cost = [turns.start(v) for v in _BASIS]
            flat = [-1 if cost[t][s] == inf else int(cost[t][s]) for s in range(4) for t in range(4)]
            ends = [rows[0].column("initial")[0].as_py(), rows[-1].column("initial")[-1].as_py()]
            yield pa.RecordBatch.from_pydict({"part": pa.array([me], pa.int32()), "number": pa.array([number], pa.int64()), "conv": pa.array([conv], rows[0].schema.field("conv").type), "cost": pa.array([flat], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.string()))})


def _exits(ends: dict) -> Callable:
    """The state in which each of the parts in ends (part, number: the vector at its end) is left, from each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        for number, _, _, turns, _ in _parts(batches):
            if (me, number) in ends:
                out = []
                for state in range(4):
                    reachable = turns.start(ends[me, number])[state] < inf
                    *_, (_, _, _, _, left) = turns.edits(state, ends[me, number], False) if reachable else [(0, "", "", 0, state)]
                    out.append(left)
                yield pa.RecordBatch.from_pydict({"part": pa.array([me], pa.int32()), "number": pa.array([number], pa.int64()), "left": pa.array([out], pa.list_(pa.int32()))})

    return run


def _walks(known: dict) -> Callable:
    """Rows of two kinds: what a part's edits are (audit, cost, illegal), and each turn that stays or is preceded by inserted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        for number, _, conv, turns, rows in _parts(batches):
            state, end, last, before = known.get((me, number), (START, END, True, None))
            audit, stays, tail = [], [], ""
            for i, letters, head, to, _ in turns.edits(state, end, last):
                audit.append(letters)
                if i == len(turns.free):
                    tail = head
                elif letters.lstrip("I")[:1] in ("K", "R") or head:
                    stays.append((i, head, "" if to == START else None if to == -1 else ROLE[to]))
            letters, illegal = "".join(audit), 0
            at = 0
            for b in rows:
                for initial, n in zip(b.column("initial").to_pylist(), b.column("n").to_pylist(), strict=True):
                    illegal += n - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
                    before = initial
            cost = DELETE * letters.count("D") + INSERT * letters.count("I") + REROLE * letters.count("R") + LATE * sum(turns.late[i] for i, _, said in stays if said != "")
            yield dict(conv=conv, part=me, audit=letters, cost=cost, illegal=illegal)
            if tail:
                yield dict(conv=conv, tail=True, head=tail)
            at, stay = 0, iter(stays)
            nxt = next(stay, None)
            for b in rows:
                turn, role, digest = (b.column(c) for c in ("turn", "role", "digest"))
                while nxt and nxt[0] < at + b.num_rows:
                    i, head, said = nxt
                    own = role[i - at].as_py()
                    yield dict(conv=conv, tail=False, head=head, said=own if said is None else said, keeps=said != "", turn=turn[i - at].as_py(), role=own, digest=digest[i - at].as_py())
                    nxt = next(stay, None)
                at += b.num_rows

    return run


def _batched(run: Callable, schema: pa.Schema, rows: int = 5000) -> Callable:
    """run, which yields rows as dictionaries, with batches of about `rows` of them."""

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in run(batches):
            held.append(row)
            size += len(row.get("text") or row.get("piece") or "")
            if len(held) >= rows or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return batched


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """Conversation and lines (role, text) of each row that stays, in order."""
    for b in batches:
        for conv, head, said, keeps, text in zip(*(b.column(c).to_pylist() for c in ("conv", "head", "said", "keeps", "text")), strict=True):
            lines = [("user" if c == "u" else "assistant", "") for c in head or ""]
            yield conv, lines + ([(said, text)] if keeps else [])


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    at, me = 0, TaskContext.get().partitionId()
    for conv, lines in _lines(batches):
        for role, text in lines:
            yield dict(conv=conv, part=me, number=at, role=role, text=text)
            at += 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The hash of each short conversation that lies inside the task; of long ones, and of the first and the last one, which may go on elsewhere, the bytes in pieces, each line after a line feed."""
    me, number, conv, held, parted = TaskContext.get().partitionId(), 0, None, None, True

    def piece() -> dict:
        nonlocal number, held, parted
        row = dict(conv=conv, part=me, number=number, piece=bytes(held))
        number, held, parted = number + 1, bytearray(), True
        return row

    for c, lines in _lines(batches):
        if held is None or c != conv:
            if held is not None and not parted:
                yield dict(conv=conv, sha256=hashlib.sha256(held[1:]).hexdigest())
            elif held:
                yield piece()
            conv, parted, held = c, held is None, bytearray()
        for role, text in lines:
            held += f"\n{role}:{text}".encode("utf-8", "surrogatepass")
        if len(held) > PIECE:
            yield piece()
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The hash of each conversation from its pieces, which come in order; none of them is held."""
    conv, sha = None, None
    for b in batches:
        for c, data in zip(b.column("conv").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if sha is None or c != conv:
                if sha is not None:
                    yield dict(conv=conv, sha256=sha.hexdigest())
                conv, sha, data = c, hashlib.sha256(), data[1:]
            sha.update(data)
    if sha is not None:
        yield dict(conv=conv, sha256=sha.hexdigest())


class Repair:
    """The repair of a table of turns; edits are computed once, what is read from it is not.

    A null id is a conversation of its own. Turns go by turn (null first), then by role and the MD5 of the text. A null role or text is one space. Equal rows are one turn and its duplicates. Other columns are ignored, whatever
    their names; an empty table gives empty results.
    """

    def __init__(self, turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        spark = turns.sparkSession
        shared_dir(spark)
        self.conv_col, self.n = conv_col, partitions(spark)
        blank = F.lit(" ")
        self.texts = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, blank).alias("role"), F.coalesce(text_col, blank).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
        end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
        light = self.texts.select("conv", "turn", "role", "digest", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("late"))
        runs = light.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("late").alias("late"))
        first = runs.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("m")).select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("m.turn").alias("t"), F.lit(False).alias("seen"))
        same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
        marked = runs.join(first, same, "left").select("conv", "turn", "role", "digest", "n", "blank", "late", F.coalesce("seen", F.lit(True)).alias("seen"), F.left("role", F.lit(1)).alias("initial"))
        order = ["conv", "turn", "role", "digest"]
        self.turns = marked.repartitionByRange(self.n, *order).sortWithinPartitions(*order).checkpoint()
        self.edits = self._edits().checkpoint()

    def _edits(self) -> DataFrame:
        kind = self.turns.schema["conv"].dataType.simpleString()
        found = self.turns.mapInArrow(_edges, f"part int, number long, conv {kind}, cost array<bigint>, ends array<string>").collect()  # two a partition at most
        found = sorted(found, key=lambda r: (r["part"], r["number"]))
        chains, known, ends = [], {}, {}
        for r in found:
            if chains and chains[-1][-1]["conv"] == r["conv"]:
                chains[-1].append(r)
            else:
                chains.append([r])
        chains = [c for c in chains if len(c) > 1]
        for chain in chains:
            v = END
            for r in reversed(chain):
                ends[r["part"], r["number"]] = v
                v = tuple(min(inf if r["cost"][4 * s + t] < 0 else r["cost"][4 * s + t] + v[t] for t in range(4)) for s in range(4))
        if ends:
            left = {(r["part"], r["number"]): r["left"] for r in self.turns.mapInArrow(_exits(ends), "part int, number long, left array<int>").collect()}
            for chain in chains:
                state, before = START, None
                for r in chain:
                    key = r["part"], r["number"]
                    known[key] = state, ends[key], r is chain[-1], before
                    state, before = left[key][state], r["ends"][1]
        fields = [("conv", None), ("part", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("tail", pa.bool_()), ("turn", None), ("role", pa.string()), ("digest", pa.binary()), ("head", pa.string()), ("said", pa.string()), ("keeps", pa.bool_())]
        types = {"conv": kind, "turn": self.turns.schema["turn"].dataType.simpleString()}
        schema = pa.schema([(name, t or _arrow(self.turns, name)) for name, t in fields])
        return self.turns.mapInArrow(_batched(_walks(known), schema), f"conv {kind}, part int, audit string, cost long, illegal long, tail boolean, turn {types['turn']}, role string, digest binary, head string, said string, keeps boolean")

    def _kept(self) -> DataFrame:
        """The turns that stay with their texts, and inserted ones, sorted in ranges."""
        keys = ["conv", "tail", "turn", "role", "digest"]
        edits = self.edits.where("tail is not null").select(*keys, "head", "said", "keeps", F.lit(None).cast("string").alias("text"))
        texts = self.texts.where(F.trim("text", F.lit(SPACES)) != "").select("conv", F.lit(False).alias("tail"), "turn", "role", "digest", F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("said"), F.lit(None).cast("boolean").alias("keeps"), "text")
        met = edits.union(texts).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("head", "said", "keeps", "text")]).where("head is not null")
        return met.repartitionByRange(self.n, *keys).sortWithinPartitions(*keys)

    def repaired(self) -> DataFrame:
        """The repaired conversations: conv_col, part and number (which give the order), role and text of each turn; inserted turns have empty texts."""
        kept = self._kept()
        schema = pa.schema([("conv", _arrow(kept, "conv")), ("part", pa.int32()), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        return kept.mapInArrow(_batched(_turn_rows, schema), f"conv {kept.schema['conv'].dataType.simpleString()}, part int, number long, role string, text string").withColumnRenamed("conv", self.conv_col)

    def digests(self) -> DataFrame:
        """conv and the SHA-256 of role:text of its repaired turns, joined by line feeds, for conversations that keep a turn."""
        kept = self._kept()
        conv, kind = ("conv", _arrow(kept, "conv")), kept.schema["conv"].dataType.simpleString()
        schema = pa.schema([conv, ("part", pa.int32()), ("number", pa.int64()), ("piece", pa.binary()), ("sha256", pa.string())])
        found = kept.mapInArrow(_batched(_pieces, schema), f"conv {kind}, part int, number long, piece binary, sha256 string").checkpoint()
        parted = found.where("piece is not null").select("conv", "part", "number", "piece").repartition(self.n, "conv").sortWithinPartitions("conv", "part", "number")
        return found.where("sha256 is not null").select("conv", "sha256").union(parted.mapInArrow(_batched(_digests, pa.schema([conv, ("sha256", pa.string())])), f"conv {kind}, sha256 string"))

    def report(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation that has a turn."""
        faults = self.turns.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(~F.col("blank"), F.col("n") - (~F.col("seen")).cast("int")).otherwise(0)).alias("duplicate"), F.sum(F.when(~F.col("blank") & ~F.col("seen") & F.col("late"), 1).otherwise(0)).alias("truncated"),
        )
        parts = self.edits.where("audit is not null").groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("parts"))
        parts = parts.select(F.col("conv").alias("c"), "illegal", "cost", F.array_join("parts.audit", "").alias("audit"))
        shas = self.digests().select(F.col("conv").alias("k"), "sha256")
        empty = hashlib.sha256(b"").hexdigest()
        all_ = faults.join(parts, F.col("conv").eqNullSafe(F.col("c"))).join(shas, F.col("conv").eqNullSafe(F.col("k")), "left")
        return all_.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls become one space first, and ids and turns one space in what is hashed."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cost, edits and the hash of the repaired turns of every conversation, after planted damage; zeros, no edits and the empty string's hash for one that lost all its rows."""
    turns = table(spark, sf_dir, "conversations")
    report = Repair(damaged(turns)).report()
    every = turns.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.na.fill(zeros | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
