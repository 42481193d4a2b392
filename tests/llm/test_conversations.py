"""Conversation repair against a brute-force search over edits."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tallgrass.llm import convrepair
from tallgrass.llm.convrepair import Repair, Turns, damaged, op11_conversation_repair

sys.setrecursionlimit(20_000)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, list[tuple[str, str]]]:
    """rows: (role, text, must go, late). Cost, initials and turns of the least (cost, initials), by recursion over all edits."""

    @lru_cache(None)
    def best(i: int, state: int, inserts: int):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        for role in ("user", "assistant"):
            if inserts < 3 and (to := STEP.get((state, role[0]))) is not None and (rest := best(i, to, inserts + 1)):
                found.append((2 + rest[0], "I" + rest[1], ((role, ""), *rest[2])))
        if i < len(rows):
            role, text, gone, late = rows[i]
            rest = best(i + 1, state, 0)
            if rest:
                found.append((3 + rest[0], "D" + rest[1], rest[2]))
            for new, letter, cost in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                if not gone and (to := STEP.get((state, new[:1]))) is not None and (rest := best(i + 1, to, 0)):
                    found.append((cost + late + rest[0], letter + rest[1], ((new, text), *rest[2])))
        return min(found, default=None)

    return best(0, 0, 0)


def expected(rows: list[tuple]) -> dict:
    """op11's columns of each conversation, one row after the other."""
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv]
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in found:
            end = text.strip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, turns = cheapest(marked)
        known = [t for t, _, _ in found if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def made(n: int, seed: int = 3) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), role, rng.choice(["Yes.", "No!  ", "so", " \t", "", None, "ä?\n", "Yes.", f"turn {turn}."])))
    return rows + rows[:7]


def run_query(spark, tmp_path, rows: list[tuple], schema: str = SCHEMA) -> dict:
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}


def test_equals_brute_force(spark, tmp_path):
    rows = made(150)
    assert run_query(spark, tmp_path, rows) == expected(rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op11_conversation_repair(spark, sf).collect()}
    assert got == expected(rows)


def test_one_conversation_over_many_tasks(spark, tmp_path, monkeypatch):
    """Nearly all rows are of one conversation, so that its parts lie in several tasks; the hash is made of several pieces."""
    monkeypatch.setattr(convrepair, "PIECE", 200)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), rng.choice(["Yes.", "no", "", f"turn {t}."])) for t in range(400)]
    rows += [(6, 0, "user", "Hi."), (8, 0, "assistant", "Hm")]
    assert run_query(spark, tmp_path, rows) == expected(rows)


def test_repeats_and_ties(spark, tmp_path):
    """One row many times over, null turns throughout, and equal turns."""
    rows = [(1, None, "user", "Same."), (1, None, "assistant", "Same.")] * 200 + [(2, 5, "assistant", "b."), (2, 5, "assistant", "a."), (2, 5, "user", "a.")]
    assert run_query(spark, tmp_path, rows) == expected(rows)


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert run_query(spark, tmp_path, []) == {}
    rows = made(5)
    extra = "conv long, part int, digest string, n int, blank boolean, head string, " + SCHEMA
    assert run_query(spark, tmp_path, [(1, 2, "x", 3, True, "y", *r) for r in rows], extra) == expected(rows)


def test_all_rows_lost(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run_query(spark, tmp_path, [(conv, 0, "user", "a.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_are_legal(spark):
    df = spark.createDataFrame(made(40), SCHEMA)
    rows = Repair(damaged(df)).repaired().orderBy("conv_id", "part", "number").collect()
    roles = defaultdict(str)
    for r in rows:
        roles[r["conv_id"]] += r["role"][0]
    assert roles and all(v.removeprefix("s") == "ua" * (len(v) // 2) for v in roles.values())


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000])
def test_checkpoints_give_the_stored_walk(n):
    rng = random.Random(n)
    turns = Turns()
    for _ in range(n):
        turns.add(rng.choice("sauax"), rng.random() < 0.8, rng.random() < 0.3, rng.choice([0, 0, 1, 2]))
    vectors = [convrepair.END]
    for i in reversed(range(n)):
        vectors.append(turns.before(i, vectors[-1]))
    letters = "".join(e[1] for e in turns.edits(0, convrepair.END, True))
    late = sum(turns.late[i] for i, e, *_ in turns.edits(0, convrepair.END, True) if i < n and e.strip("I")[:1] in ("K", "R"))
    assert 3 * letters.count("D") + 2 * letters.count("I") + 2 * letters.count("R") + late == vectors[-1][0]
