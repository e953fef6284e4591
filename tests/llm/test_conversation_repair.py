"""Repair of conversations against a search over all edits, and on edge rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import conversation_repair as cr

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def search(rows):
    """(cost, audit, repaired lines) by trying all edits; rows: (role, text, must_go, cut_off)."""
    best = [None]

    def go(i, out, cost, edits, inserted, lines):
        if best[0] and cost > best[0][0]:
            return
        if i == len(rows):
            if LEGAL.match(out) and (best[0] is None or (cost, edits) < best[0][:2]):
                best[0] = (cost, edits, lines)
        else:
            role, text, must_go, cut_off = rows[i]
            go(i + 1, out, cost + 2, edits + "D", 0, lines)
            if not must_go:
                more = 5 * cut_off
                go(i + 1, out + (role[:1] or "?"), cost + more, edits + "K", 0, [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, out + new[0], cost + 1 + more, edits + "R", 0, [*lines, f"{new}:{text}"])
        if inserted < 3:
            for new in ("user", "assistant"):
                go(i, out + new[0], cost + 5, edits + "I", inserted + 1, [*lines, f"{new}:"])

    go(0, "", 0, "", 0, [])
    return best[0]


def brute(table, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        rows = convs[conv]
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (turn is not None, turn or 0, "user" if fault == 4 else role, text)
        rows += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort()
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults = [not bare, (role, text) in seen, bare[-1:] not in (".", "!", "?")]
            seen.add((role, text))
            first = faults.index(True) if any(faults) else 3
            if first < 3:
                counts[first] += 1
            judged.append((role, text, first < 2, first == 2))
        turns = {t for known, t, *_ in rows if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = search(judged)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table():
    rng = random.Random(8)
    rows = [(1, None, None, None), (1, 3, "user", None), (2, 5, "", "x."), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (3, -4, "système", "s?"), (3, 9, "assistant", "ü!\n"), (4, 1, "user", " \t\n"), (5, 1, "tool", "z."), (5, 2, "tool", "z.")]
    for conv in range(10, 150):
        for turn in range(rng.randrange(1, 8)):
            turn = rng.choice([turn, turn, turn, turn + 5, None])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "s"]), rng.choice(["hello.", "what?", "no end", "", f"text {rng.randrange(99)}!", "x.\x85", "dot. \x0b"])))
    return rows


def held(df):
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(table(), ROWS).withColumns({c: F.lit("clash") for c in ("valid", "blank", "duplicate", "cut_off", "fault", "copy", "audit")})


@pytest.mark.parametrize("damage", [True, False])
def test_brute_force(made, damage):
    rows = cr.damaged(made) if damage else made
    found = held(cr.audits(rows, F.col("valid") if damage else None))
    assert found == brute(table(), damage)
    assert {len(set(x[7]) & set("DIKR")) for x in found} >= {1, 2, 3}


def test_repaired_turns(made):
    turns = defaultdict(list)
    for r in cr.repaired(made).orderBy("conv_id", "place").collect():
        assert r.place == len(turns[r.conv_id])
        turns[r.conv_id].append((r.edit, r.role, r.text))
    for conv, *_, audit, digest in brute(table(), damage=False):
        kept = turns[conv]
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in kept).encode()).hexdigest() == digest
        assert "".join(e for e, *_ in kept) == audit.replace("D", "") and LEGAL.match("".join(role[0] for _, role, _ in kept))


def test_long_conversation(spark):
    """No string of edits is held while turns pass, and what is remembered of steps stays small."""
    rng = random.Random(2)
    long = cr.Repair()
    for i in range(200_000):
        long.add(i, rng.choice(["user", "assistant", "system", "tool"]), str(i), rng.random() < 0.1, False, rng.random() < 0.2)
    gaps, *_, cost, audit, _ = long.result()
    assert gaps == 0 and sum(x != "I" for x in audit) == 200_000 and len(cr.Repair.memo) < 2000
    assert cost >= 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I")


def test_empty_and_dropped(spark, made):
    assert cr.audits(made.limit(0)).count() == cr.repaired(made.limit(0)).count() == 0
    none = cr.audits(made, F.lit(None).cast("boolean"))
    assert none.count() == made.select("conv_id").distinct().count()
    assert {tuple(r)[1:] for r in none.collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_string_ids(spark):
    rows = spark.createDataFrame([("a", 1, "user", "x."), ("b", 1, "assistant", "y.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit) for r in cr.audits(rows).orderBy("conv_id").collect()] == [("a", "D"), ("b", "D")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert held(cr.op12_conversation_repair(spark, sf)) == brute(rows)
