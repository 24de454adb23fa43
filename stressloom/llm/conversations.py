"""Repair of conversation structure by distinct signatures (operator 13).

A conversation becomes a short string, a character a row: its role's initial where that is s, u or a, else o; in upper case if the text is truncated; x if
the row has to go. Equal strings have equal cheapest edits, so each distinct one is solved once, and its audit is joined back and replayed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, small_batches

_solid = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: What the edits cost, and the pairs of initials that may stand next to each other.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = frozenset(("su", "ua", "au"))
_NEVER = 1 << 60
#: What has been given out so far: nothing, a system row, up to a user row, up to an assistant row; and the role that an insertion or a new role gives then.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
_AT_ONCE = 300  # rows by which the recursion goes deeper at a time

TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _kept(state: int, initial: str) -> int | None:
    """The state after a row of this initial is kept; None where the grammar doesn't take it."""
    if initial == "s":
        return _SYSTEM if state == _NONE else None
    if initial == "u":
        return _USER if state != _USER else None
    return _ASSISTANT if initial == "a" and state == _USER else None


def _edits(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after it) of each edit of a row, in the order of letters."""
    yield "D", DELETE, state
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        after = _kept(state, symbol.lower())
        if after is not None:
            yield "K", KEEP + more, after
        yield "R", REROLE + more, _NEXT[state]


def solve(signature: str) -> tuple[int, str]:
    """The least cost and its audit, the ASCII-least of equal cost: a letter an edit, D, I, K or R. In each state an edit's letter tells what it gives, so letters alone
    order the edits of equal cost."""
    n = len(signature)
    known: dict[int, tuple[int, ...]] = {}

    def least(i: int) -> tuple[int, ...]:
        """By state, the least cost of the rows from i on."""
        if i in known:
            return known[i]
        if i == n:
            here = [0, _NEVER, _NEVER, 0]
        else:
            rest = least(i + 1)
            here = [min(cost + rest[after] for _, cost, after in _edits(signature[i], state)) for state in range(4)]
        user = min(here[_USER], INSERT + here[_ASSISTANT])
        assistant = min(here[_ASSISTANT], INSERT + here[_USER])
        known[i] = min(here[_NONE], INSERT + user), min(here[_SYSTEM], INSERT + user), user, assistant
        return known[i]

    for i in range(n, -1, -_AT_ONCE):
        least(i)
    i, state, audit = 0, _NONE, []
    while i < n or least(i)[state]:
        now = least(i)[state]
        steps = [(letter, cost + least(i + 1)[after], i + 1, after) for letter, cost, after in _edits(signature[i], state)] if i < n else []
        steps.append(("I", INSERT + least(i)[_NEXT[state]], i, _NEXT[state]))
        letter, _, i, state = min(step for step in steps if step[1] == now)
        audit.append(letter)
    return least(0)[_NONE], "".join(audit)


def replay(turns: list[dict], audit: str) -> list[dict]:
    """The rows that an audit leaves, (role, text) each."""
    state, rows, out = _NONE, iter(turns), []
    for letter in audit:
        if letter == "I":
            out.append({"role": _ROLE[state], "text": ""})
            state = _NEXT[state]
            continue
        row = next(rows)
        if letter == "K":
            state = _kept(state, row["role"][:1])
            out.append({"role": row["role"], "text": row["text"]})
        elif letter == "R":
            out.append({"role": _ROLE[state], "text": row["text"]})
            state = _NEXT[state]
    return out


def _told(turns: list[dict]) -> tuple[str, int, int, int, int, int]:
    """Signature, gaps, blank, duplicate, truncated, illegal."""
    seen: set[tuple[str, str]] = set()
    signature, counts, illegal, before = [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
    for row in turns:
        role, text = row["role"], row["text"]
        said = (role, text)
        if not _solid.search(text):
            fault = "blank"
        elif said in seen:
            fault = "duplicate"
        else:
            fault = "truncated" if text.rstrip(_SPACE)[-1] not in ".!?" else ""
        seen.add(said)
        if fault:
            counts[fault] += 1
        initial = role[:1]
        symbol = initial if initial in ("s", "u", "a") else "o"
        signature.append("x" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
        if before is not None and before + initial not in LEGAL:
            illegal += 1
        before = initial
    at = {row["turn"] for row in turns} - {None}
    gaps = max(at) - min(at) + 1 - len(at) if at else 0
    return "".join(signature), gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal


_TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [_told(turns) for turns in batch.column("turns").to_pylist()]
        first, *numbers = zip(*told, strict=True) if told else ((),) * 6
        yield pa.record_batch([batch.column("conv_id"), batch.column("turns"), pa.array(first, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["conv_id", "turns", "signature", *_TOLD])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost, audit = zip(*map(solve, batch.column("signature").to_pylist()), strict=True) if batch.num_rows else ((), ())
        yield pa.record_batch([batch.column("signature"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        out = [replay(turns, audit) for turns, audit in zip(batch.column("turns").to_pylist(), batch.column("audit").to_pylist(), strict=True)]
        rest = [c for c in batch.schema.names if c != "turns"]
        yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(out, kind)], [*rest, "repaired"])


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to the rows that a hash of `conv_id:turn` damages, with `gone` where it drops one: null ids count as a space there, null roles and
    texts become one."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("_by"))
    by = F.col("_by")
    text = F.when(by == 1, "").when(by == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(by == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (by == 0).alias("gone"), F.when(by == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")


def repair(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text and perhaps gone: rows that only name their conversation) to a row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, signature and repaired,
    the rows (role, text) that the cheapest edits leave.

    Rows go by turn, null turns first, and rows of one turn by role and text, so repeated rows stand side by side. Null role or text: one space. Null conv_id: all such rows are one conversation. A conversation
    without rows, or of rows that are all gone: zeros, no edits, nothing repaired. Other columns are ignored. An empty table gives an empty result. A conversation is one row, so its texts, very long ones
    too, meet in one task; conversations are dealt by conv_id, and signatures of any number of conversations are solved once.
    """
    small_batches(turns.sparkSession, 256)
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    row = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    if "gone" in turns.columns:
        row = F.when(~F.coalesce("gone", F.lit(False)), row)
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    kind = whole.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turns array<struct<turn:long,role:string,text:string>>, signature string, {', '.join(f'{c} long' for c in _TOLD)}"
    encoded = cut(whole.mapInArrow(_encode, schema))
    solved = cut(encoded.select("signature").distinct().mapInArrow(_solve, "signature string, cost long, audit string"))
    joined = encoded.join(solved, "signature")
    schema = f"signature string, conv_id {kind}, {', '.join(f'{c} long' for c in _TOLD)}, cost long, audit string, repaired array<struct<role:string,text:string>>"
    return joined.mapInArrow(_replay, schema)


def digest(repaired: DataFrame) -> DataFrame:
    """The columns of the query, from the repaired rows."""
    lines = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return repaired.select("conv_id", *_TOLD, "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
