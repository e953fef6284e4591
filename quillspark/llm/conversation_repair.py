"""Repair of conversation structure by a dynamic program over retained turns.

A repaired conversation's role initials are ``(s?(ua)+)?``. Turns are kept (0), given another role (1) or deleted (2, which
blank and repeated turns must be), turns without text are inserted (5), and a retained turn that is cut off costs 5 more.
The program chooses the retained turns: between two of them all turns are deleted, and the pair of their roles says what
must be inserted. Costs are taken less the sum of deletions so far, so that a gap of any length is priced by the running
minimum of each role of the last retained turn. Of equal costs the ASCII-least string of edits wins: strings in play have
used up the same turns, so none is a prefix of another, and their order is carried on as a rank per role.

What is known after a turn (four differences of costs, their ranks) has few values, so steps are remembered. Each role
carries a running SHA-256 of its best repaired text, and one number a turn to trace back; texts are never held. Turns are
shuffled by conversation once, and sorted there; a conversation is one stream in one task, as its hash and its audit are
of the whole, and needs 4 bytes a turn and what the audit takes.

Nulls: a null role or text is one space. Turns go by ``turn``, nulls first, then role, then text. A null conv_id is a
conversation. Repeated rows are duplicates. Other roles than s..., u..., a... (the empty one, too) can't be kept as they are. Empty tables give
empty results, and a conversation without valid rows zeros, an empty audit and the hash of nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import fold, read_table

DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: What is inserted between the role of one retained turn and the next ("" is the start); missing pairs can't follow.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
AT_END = {"": "", "s": "ua", "u": "a", "a": ""}
ROLES = {"u": "user", "a": "assistant"}
#: A role whose cost is more than this above the least can't win any more: whatever follows it can follow the least one for
#: one deletion and two insertions more.
HOPELESS = DELETE + 2 * INSERT
Known = tuple[tuple[str, int, int], ...]  # (role, cost above the least, rank of its edits)
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "array<struct<edit: string, row: long, role: string>>"


def step(known: Known, initial: str, must_go: bool, cut_off: bool) -> tuple[Known, int, dict[str, tuple[str, str]]]:
    """After one more turn: what is known, by how much the least cost changed (less DELETE), and for each role the role
    before and the edits since.
    """
    found = {}
    for role, cost, rank in known:
        options = [(role, cost, "D")]
        for y in "sua" if not must_go else "":
            if (role, y) in BETWEEN and (y == initial or y != "s"):
                gap = BETWEEN[role, y]
                options.append((y, cost + INSERT * len(gap) + (REROLE if y != initial else 0) + (CUT_OFF if cut_off else 0) - DELETE, "I" * len(gap) + ("K" if y == initial else "R")))
        for y, c, edits in options:
            new = (c, rank, edits, role)
            if y not in found or new < found[y]:
                found[y] = new
    least = min(c for c, *_ in found.values())
    found = {y: x for y, x in found.items() if x[0] - least <= HOPELESS}
    order = sorted(found, key=lambda y: found[y][1:3])
    return tuple((y, found[y][0] - least, order.index(y)) for y in sorted(found)), least, {y: (x[3], x[2]) for y, x in found.items()}


class Repair:
    """One conversation, turn by turn."""

    memo: dict = {}
    plans: list[dict[str, tuple[str, str]]] = []

    def __init__(self) -> None:
        self.known: Known = (("", 0, 0),)
        self.cost = self.turns = self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.initial = None
        self.hashes = {"": hashlib.sha256()}
        self.path = array("I")

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, cut_off: bool) -> None:
        initial = role[:1]
        if turn is not None:
            self.distinct += self.last is None or turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.blank += blank
        self.duplicate += duplicate and not blank
        cut_off = cut_off and not blank and not duplicate
        self.truncated += cut_off
        key = (self.known, initial if initial in ("s", "u", "a") else "", blank or duplicate, cut_off)
        if key not in self.memo:
            known, change, plan = step(*key)
            self.memo[key] = (known, change, len(self.plans))
            self.plans.append(plan)
        self.known, change, plan = self.memo[key]
        self.cost += change + DELETE
        self.turns += 1
        self.path.append(plan)
        before, self.hashes = self.hashes, {}
        for y, (x, edits) in self.plans[plan].items():
            h = before[x]
            if edits != "D":
                h = h.copy()
                lines = [f"{ROLES[i]}:" for i in BETWEEN[x, y]] + [f"{ROLES[y] if edits[-1] == 'R' else role}:{text}"]
                h.update((("\n" if x else "") + "\n".join(lines)).encode())
            self.hashes[y] = h

    def best(self) -> tuple[int, str]:
        cost, _, role = min((c + INSERT * len(AT_END[y]), rank, y) for y, c, rank in self.known)
        return self.cost + cost, role

    def steps(self) -> list[tuple[str, str, str]]:
        """(role before, role after, edits) of each turn on the cheapest way."""
        _, role = self.best()
        out = []
        for plan in reversed(self.path):
            x, edits = self.plans[plan][role]
            out.append((x, role, edits))
            role = x
        return out[::-1]

    def edits(self) -> list[dict]:
        out = []
        for row, (x, y, edits) in enumerate(self.steps()):
            if edits != "D":
                out += [{"edit": "I", "row": None, "role": ROLES[i]} for i in BETWEEN[x, y]]
            out.append({"edit": edits[-1], "row": row, "role": ROLES[y] if edits[-1] == "R" else None})
        return out + [{"edit": "I", "row": None, "role": ROLES[i]} for i in AT_END[self.best()[1]]]

    def result(self) -> tuple:
        cost, role = self.best()
        h = self.hashes[role]
        h.update("".join(f"\n{ROLES[i]}:" for i in AT_END[role]).encode())
        audit = "".join(edits for *_, edits in self.steps()) + "I" * len(AT_END[role])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, h.hexdigest()


def _ordered(turns: DataFrame, valid: Column | None) -> DataFrame:
    """(conv_id, turn, role, text, valid, blank, duplicate, cut_off), each conversation in one place and in order."""
    space = r"[\x20\x09-\x0D]"
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))).alias("valid"))
    seen = Window.partitionBy("conv_id", "valid", "role", "text").orderBy(F.asc_nulls_first("turn"))  # within a conversation's place: no exchange
    rows = rows.repartition("conv_id").withColumn("duplicate", F.row_number().over(seen) > 1)
    rows = rows.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut_off": ~F.col("text").rlike(rf"[.!?]{space}*\z")})
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "duplicate")


def audits(turns: DataFrame, valid: Column | None = None, edits: bool = False) -> DataFrame:
    """One row per conversation: conv_id, FIELDS and, if asked for, ``edits`` (edit, row: place of the turn from 0, role: the
    new one or null). Rows where ``valid`` isn't true only say that their conversation exists.
    """
    rows = _ordered(turns, valid)
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["edits"] * edits
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("edit", pa.string()), ("row", pa.int64()), ("role", pa.string())]))] * edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        name = kind = None

        def batch(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * (1 + len(kinds))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names=["conv_id", *names])

        def end() -> tuple:
            return (name, *((*now.result(), now.edits()) if edits else now.result()))

        for x in batches:
            kind, done = x.schema.field("conv_id").type, []
            for conv, turn, role, text, ok, again, blank, cut_off in zip(*(x.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "valid", "duplicate", "blank", "cut_off")), strict=True):
                if now is None or conv != name:
                    if now:
                        done.append(end())
                    now, name = Repair(), conv
                if ok:
                    now.add(turn, role, text, blank, again, cut_off)
            yield batch(done)
        if now:
            yield batch([end()])

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FIELDS}" + f", edits {EDITS}" * edits)


def repaired(turns: DataFrame, valid: Column | None = None) -> DataFrame:
    """The turns of all repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""
    way = audits(turns, valid, edits=True).select("conv_id", F.posexplode("edits").alias("at", "e")).select("conv_id", "at", "e.*").filter("edit <> 'D'")
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "duplicate")
    rows = _ordered(turns, valid).filter("valid").select(F.col("conv_id").alias("own_id"), F.col("role").alias("own_role"), "text", (F.row_number().over(place) - 1).cast("long").alias("own_row"))
    out = way.join(rows, way["conv_id"].eqNullSafe(rows["own_id"]) & (way["row"] == rows["own_row"]), "left")
    return out.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("at")) - 1).alias("place"), "edit", F.coalesce("role", "own_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with one fault in some rows, by a hash of conversation and turn; ``valid`` is false for those dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (fold(key) % 20).alias("fault"))
    fault = F.col("fault")
    rows = rows.withColumns({
        "valid": fault != 0, "role": F.when(fault == 4, "user").otherwise(F.col("role")), "text": F.when(fault <= 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "copy": F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.drop("fault", "copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return audits(rows, F.col("valid"))


def _sql() -> str:
    """The program by turns, with whole strings of edits and whole texts, as a recursive query."""
    def grown(x: str, y: str) -> str:
        gap = BETWEEN[x, y]
        lines = "".join(f"{ROLES[i]}:' || chr(10) || '" for i in gap)
        new = ROLES.get(y, "")
        same = f"i = '{y}'"
        role = f"CASE WHEN {same} THEN role ELSE '{new}' END"
        able = f"NOT must_go AND p.b{x} IS NOT NULL" + (f" AND {same}" if y == "s" else "")
        return (
            f"CASE WHEN {able} THEN {{'c': p.b{x}.c + {INSERT * len(gap)} + CASE WHEN {same} THEN 0 ELSE {REROLE} END + CASE WHEN cut_off THEN {CUT_OFF} ELSE 0 END, "
            f"'e': p.b{x}.e || '{'I' * len(gap)}' || CASE WHEN {same} THEN 'K' ELSE 'R' END, 't': p.b{x}.t || {"chr(10)" if x else "''"} || '{lines}' || {role} || ':' || text}} END"
        )

    def least(options: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda z: z IS NOT NULL))[1]"

    def state(y: str) -> str:
        stay = f"CASE WHEN p.b{y} IS NOT NULL THEN {{'c': p.b{y}.c + {DELETE}, 'e': p.b{y}.e || 'D', 't': p.b{y}.t}} END"
        return least([stay] + [grown(x, z) for x, z in BETWEEN if z == y])

    def final(y: str) -> str:
        gap = AT_END[y]
        return f"CASE WHEN p.b{y} IS NOT NULL THEN {{'c': p.b{y}.c + {INSERT * len(gap)}, 'e': p.b{y}.e || '{'I' * len(gap)}', 't': p.b{y}.t || '{''.join(f"' || chr(10) || '{ROLES[i]}:" for i in gap)}'}} END"

    kind = "NULL::STRUCT(c BIGINT, e VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), f AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fault FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0
), r AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open FROM d
), t AS (
  SELECT *, blank OR again AS must_go, open AND NOT blank AND NOT again AS cut_off, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM r
), c AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut_off) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id
), p AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS b, {kind} AS bs, {kind} AS bu, {kind} AS ba FROM c
  UNION ALL
  SELECT p.conv_id, t.n, {state("")}, {state("s")}, {state("u")}, {state("a")}
  FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = p.n + 1
), z AS (
  SELECT p.conv_id, {least([final(y) for y in AT_END])} AS w FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.n = c.n
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.c, 0) AS cost, coalesce(w.e, '') AS audit, sha256(coalesce(w.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON o.conv_id IS NOT DISTINCT FROM z.conv_id
"""


OP12_SQL = _sql()
