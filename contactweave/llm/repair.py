"""Repair of conversations by Knuth's generalisation of Dijkstra's algorithm.

A conversation's repair is a derivation in a weighted deduction system.

* ``row i as r``: an edit of row i that leaves the role initial r, or nothing: Keep costs
  0, Rerole (to user or assistant) 1, Delete 2; a row left in place costs 5 more if it is
  truncated; blank and duplicate rows can only be deleted.
* ``rest i, q``: the rows from i on, repaired so that the grammar ``(s?(ua)+)?`` accepts
  what they leave when it stands in state q.  It follows from ``row i as r`` and
  ``rest i+1, q'``, or, at a cost of 5, from ``rest i, q'`` and an inserted empty turn.
* The goal is ``rest 0, start``; the axioms are the edits and the accepted ends.

Values are (cost, rows covered, audit), and every rule adds costs and rows and puts the
edit's initial before the audit, so a conclusion is larger than what it follows from and
grows with it: the functions are superior, and the agenda, which pops the least value
first, finalises each item once, until the goal is popped.  (Built from the front, audits
wouldn't be monotone, as one can begin another.)  Rows covered only matter between items
of different rows, so the goal has the least cost and, of these, the ASCII-least audit.
Audits are shared lists, so an item costs no more than one cell.

Rows are put in order by turn (nulls first), then role, then the text's hashes.  Rows of
one conversation meet in one task, without their texts; what the task keeps of a row is
a few small values.  The digest of the repaired conversation is sequential: a second pass
streams its sorted texts through one task and keeps none of them.

Defined results: null roles and texts count as one space, as does a null conversation or
turn where rows are damaged; a null conversation id is a conversation of its own;
repeated rows are duplicates; rows of equal turns go in the order above; roles that begin
with another letter than s, u or a can't be kept; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.llm.base import bounded_batches

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: start, after the system turn, after a user's, after an answer.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Repairs that a task remembers, by the rows' codes, and the longest code remembered.
_REMEMBERED, _SHORT = 100_000, 64
_LEGAL = {"su", "ua", "au"}


class Audit:
    """An edit's initial before the edits after it."""

    __slots__ = ("head", "rest")

    def __init__(self, head: str, rest: Audit | None):
        self.head, self.rest = head, rest

    def __lt__(self, other: Audit) -> bool:
        a, b = self, other
        while a is not b:
            if a is None or b is None:
                return a is None
            if a.head != b.head:
                return a.head < b.head
            a, b = a.rest, b.rest
        return False

    def __str__(self) -> str:
        out, at = [], self
        while at.head:
            out.append(at.head)
            at = at.rest
        return "".join(out)


_END = Audit("", None)


def edits(code: str) -> list[tuple[int, str, str]]:
    """(cost, initial of the edit, initial of the role it leaves or nothing) for a row:
    ``code`` is its role's initial after T if it is truncated, or D if it must go."""
    out = [(DELETE, "D", "")]
    if code != "D":
        extra = TRUNCATED if code[0] == "T" else 0
        out += [(REROLE + extra, "R", r) for r in ROLES]
        if code[-1] in "sua":
            out.append((extra, "K", code[-1]))
    return out


def lightest(codes: list[str]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    n = len(codes)
    # (cost, rows covered, audit, serial number, item); items are (place, state), edits
    # are (place, role initial or nothing, None).
    agenda: list = [(0, 0, _END, k, (n, q)) for k, q in enumerate(ENDS)]
    for i, code in enumerate(codes):
        agenda += [(cost, 1, Audit(e, _END), len(agenda) + k, (i, r, None)) for k, (cost, e, r) in enumerate(edits(code))]
    heapq.heapify(agenda)
    serial, rests, rows = len(agenda), {}, {}

    def conclude(row: tuple, of: str, i: int, after: int, rest: tuple) -> None:
        """All items that ``row`` leaving ``of`` before state ``after`` proves."""
        nonlocal serial
        for q in range(4):
            if (STEPS.get((q, of)) if of else q) == after and (i, q) not in rests:
                serial += 1
                heapq.heappush(agenda, (row[0] + rest[0], row[1] + rest[1], Audit(row[2].head, rest[2]), serial, (i, q)))

    while agenda:
        cost, covered, audit, _, item = heapq.heappop(agenda)
        value = (cost, covered, audit)
        if len(item) == 3:
            i, of, _ = item
            if (i, of) in rows:
                continue
            rows[i, of] = value
            for q in range(4):
                if (i + 1, q) in rests:
                    conclude(value, of, i, q, rests[i + 1, q])
            continue
        if item in rests:
            continue
        rests[item] = value
        i, q = item
        if item == (0, 0):
            return cost, str(audit)
        for of in ("", "s", "u", "a"):
            if (i - 1, of) in rows:
                conclude(rows[i - 1, of], of, i - 1, q, value)
        for of in ROLES:
            conclude((INSERT, 0, Audit("I", _END)), of, i, q, value)
    raise AssertionError("deleting all rows is a repair")


class _Repairs(dict):
    def __missing__(self, codes: tuple[str, ...]) -> tuple[int, str]:
        out = lightest(list(codes))
        if len(codes) <= _SHORT:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[codes] = out
        return out


def damage(rows: DataFrame, of: Column) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by ``of``, a number: 0 drops a row, 1
    empties its text, 2 takes its full stops, question and exclamation marks, 3 repeats
    it, 4 makes it the user's.  Dropped rows stay, marked by ``dropped``; ``copy`` counts
    repeats."""
    text = F.when(of == 1, F.lit("")).when(of == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(of == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(of == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (of == 0).alias("dropped"), F.explode(copies).alias("copy"))


def contract_damage(rows: DataFrame) -> DataFrame:
    """Damage drawn by each row's conversation and turn."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return damage(rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text")), F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20)




def _facts(rows: DataFrame) -> DataFrame:
    """Rows without their texts: what decides order, faults and edits."""
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    last = F.substring(bare, -1, 1)
    return rows.select("conv_id", "turn", "role", *(F.xxhash64(F.lit(s), "text").alias(f"k{s}") for s in (1, 2)), "copy", "dropped", (bare == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults, repair and its audit per conversation, from sorted facts."""
    known = _Repairs()
    schema = None

    def rows() -> Iterator[dict]:
        nonlocal schema
        for b in batches:
            schema = b.schema
            yield from b.to_pylist()

    done: list[dict] = []
    for conv, group in groupby(rows(), key=lambda r: r["conv_id"]):
        seen, codes, initials = set(), [], []
        counts = dict.fromkeys(_SUMS, 0)
        low = high = None
        turns, before = 0, None
        for r in group:
            if r["dropped"]:
                continue
            if (t := r["turn"]) is not None:
                low, high, turns = (t if low is None else low), t, turns + (t != before)
                before = t
            said = (r["role"], r["k1"], r["k2"])
            kind = "blank" if r["blank"] else "duplicate" if said in seen else "truncated" if r["open"] else ""
            seen.add(said)
            if kind:
                counts[kind] += 1
            initial = r["role"][:1]
            if initials and initials[-1] + initial not in _LEGAL:
                counts["illegal"] += 1
            initials.append(initial)
            codes.append("D" if kind in ("blank", "duplicate") else ("T" if kind else "") + (initial or "?"))
        counts["gaps"] = high - low + 1 - turns if turns else 0
        counts["cost"], audit = known[tuple(codes)]
        done.append({"conv_id": conv, **counts, "audit": audit})
        if len(done) >= 2_000 or len(audit) > 100_000:
            yield _solved(done, schema)
            done = []
    if done:
        yield _solved(done, schema)


def _solved(done: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(done, pa.schema([schema.field("conv_id"), *((c, pa.int64()) for c in _SUMS), ("audit", pa.string())]))


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired conversations' digests, from each one's audit and then its rows."""
    now = digest = None
    said = False

    def turn(initials: str, role: str | None, text: str) -> str:
        """One turn left by an edit: an edit that isn't Keep follows the grammar."""
        nonlocal said
        role = role if role is not None else ROLES["a" if initials == "u" else "u"]
        digest.update((("\n" if said else "") + f"{role}:{text}").encode())
        said = True
        return role[0]

    for b in batches:
        out, schema = [], b.schema
        for r in b.to_pylist():
            if r["audit"] is not None:
                if now is not None:
                    _insert(now, turn)
                    out.append({**now["row"], "repaired_sha256": digest.hexdigest()})
                now, digest, said = {"row": {c: r[c] for c in ("conv_id", *_SUMS, "audit")}, "at": 0, "last": ""}, hashlib.sha256(), False
                continue
            _insert(now, turn)
            edit = now["row"]["audit"][now["at"]]
            now["at"] += 1
            if edit != "D":
                now["last"] = turn(now["last"], r["role"] if edit == "K" else None, r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _told(schema))
    if now is not None:
        _insert(now, turn)
        yield pa.RecordBatch.from_pylist([{**now["row"], "repaired_sha256": digest.hexdigest()}], _told(schema))


def _insert(now: dict, turn) -> None:
    """The turns put in before the next row."""
    audit = now["row"]["audit"]
    while now["at"] < len(audit) and audit[now["at"]] == "I":
        now["at"] += 1
        now["last"] = turn(now["last"], None, "")


def _told(schema: pa.Schema) -> pa.Schema:
    return pa.schema([schema.field("conv_id"), *((c, pa.int64()) for c in _SUMS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, dropped, copy): counts of
    gaps and faults, cost and audit of the lightest repair, digest of what it leaves."""
    bounded_batches(rows.sparkSession)
    ids = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "k1", "k2", "copy"]
    sums = ", ".join(f"{c} long" for c in _SUMS)
    solved = _facts(rows).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_solve, f"conv_id {ids}, {sums}, audit string")
    texts = rows.where("not dropped").select("conv_id", "turn", "role", *(F.xxhash64(F.lit(s), "text").alias(f"k{s}") for s in (1, 2)), "copy", "text")
    both = solved.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *order[1:])
    return both.select("conv_id", *_SUMS, "audit", "role", "text").mapInArrow(_tell, f"conv_id {ids}, {sums}, audit string, repaired_sha256 string")
