"""Repair of conversations: the cheapest edits that give well-formed turns, by a rank-compressed dynamic program."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .texts import free_name

#: White space, ends of sentences, and the costs of edits.
BLANK, SENTENCE_ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
INSERT, REROLE, DELETE, UNDELETED_TRUNCATED = 5, 1, 2, 5
#: What stands so far: nothing, a system turn, a user's turn last, an assistant's turn last. Nothing and the last may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Up to two inserts and one edit of a turn. Each code ends with its only letter other than I, so none begins another, and their order is ASCII's.
CODES = sorted(run + edit for run in ("", "I", "II") for edit in "DKR")
#: Cost and inserts that complete a conversation.
ENDS = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: Turns and bytes of a block, the unit in which a long conversation is dealt out.
BLOCK_TURNS, BLOCK_BYTES = 4096, 4 << 20
FINE, TRUNCATED, DUPLICATE, EMPTY = range(4)
_TURNS = "array<struct<turn:long,role:string,text:string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECE = f"conv_id long, piece long, complete boolean, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, turns {_TURNS}"
_TURN_TYPE = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_PIECE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("complete", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("turns", _TURN_TYPE)])


def inserted(state: int) -> int:
    """The state after an insert, which is the turn that must follow."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state after a kept turn; None where it can't stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


@cache
def moves(initial: str, fault: int) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, code) of the cheapest macro edit between two states, the ASCII-least of equal ones."""
    best: dict = {}
    for start in range(4):
        state, cost, run = start, 0, ""
        for _ in range(3):
            edits = [("D", state, DELETE)]
            if fault in (FINE, TRUNCATED):
                extra = UNDELETED_TRUNCATED * (fault == TRUNCATED)
                edits += [("K", kept(state, initial), extra), ("R", inserted(state), REROLE + extra)]
            for edit, to, c in edits:
                if to is not None:
                    best[start, to] = min(best.get((start, to), (1 << 60, 0)), (cost + c, CODES.index(run + edit)))
            state, cost, run = inserted(state), cost + INSERT, run + "I"
    return tuple((s, t, *v) for (s, t), v in sorted(best.items()))


def layers(turns: list[tuple[str, int]], entry: dict[int, tuple[int, int]]) -> tuple[list[dict[int, tuple[int, int]]], dict[int, tuple[int, int]]]:
    """Pointers of each layer, state -> (state before, code), and (cost, rank) of the states after the last turn.

    ``turns`` are (initial, fault), ``entry`` has (cost, rank) of the states
    before them. Audit strings of a layer have equally many codes of a
    prefix-free set, so none begins another, and their order is that of (rank
    of the state before, code): ranks replace the strings.
    """
    live, pointers = entry, []
    for turn in turns:
        found: dict = {}
        for s, t, cost, code in moves(*turn):
            if s in live:
                c, rank = live[s]
                key = (c + cost, rank, code, s)
                if t not in found or key < found[t]:
                    found[t] = key
        order = sorted(found, key=lambda t: found[t][1:3])
        live = {t: (found[t][0], k) for k, t in enumerate(order)}
        pointers.append({t: (key[3], key[2]) for t, key in found.items()})
    return pointers, live


def traced(pointers: list[dict], state: int) -> list[str]:
    """Codes along the parent pointers that lead to ``state``, in order."""
    out = []
    for layer in reversed(pointers):
        state, code = layer[state]
        out.append(CODES[code])
    return out[::-1]


def edited(turns: list[dict], codes: list[str], state: int, tail: str = "") -> list[dict]:
    """The turns after the edits; inserted ones have no number and no text."""
    out = []
    for turn, code in [*zip(turns, codes, strict=True), *[(None, tail)] * bool(tail)]:
        for letter in code:
            if letter == "I":
                state = inserted(state)
                out.append({"turn": None, "role": ROLES[state], "text": ""})
            elif letter == "R":
                state = inserted(state)
                out.append(turn | {"role": ROLES[state]})
            elif letter == "K":
                state = kept(state, turn["role"][:1])
                out.append(turn)
    return out


def faults(turns: list[dict], repeated: set[int]) -> list[tuple[str, int]]:
    """(role's initial, fault) of each turn; ``repeated`` are the places of turns seen earlier."""
    out = []
    for k, turn in enumerate(turns):
        text = turn["text"].rstrip(BLANK)
        fault = EMPTY if not text else DUPLICATE if k in repeated else FINE if text.endswith(SENTENCE_ENDS) else TRUNCATED
        out.append((turn["role"][:1], fault))
    return out


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def summary(turns: list[dict], found: list[tuple[str, int]]) -> dict:
    """What a block adds to its conversation's counts, with what it takes to join blocks: their first and last initials and numbers."""
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    n = lambda fault: sum(f == fault for _, f in found)
    return {
        "blank": n(EMPTY), "duplicate": n(DUPLICATE), "truncated": n(TRUNCATED), "illegal": sum(illegal(a[0], b[0]) for a, b in zip(found, found[1:])),
        "initials": [found[0][0], found[-1][0]] if found else [], "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "distinct": len(set(numbers)),
    }


def joined_counts(parts: list[dict]) -> dict:
    """Counts of a conversation from the summaries of its blocks in order."""
    out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    ends = [p["initials"] for p in parts if p["initials"]]
    out["illegal"] += sum(illegal(a[1], b[0]) for a, b in zip(ends, ends[1:]))
    numbered = [p for p in parts if p["low"] is not None]
    distinct = sum(p["distinct"] for p in numbered) - sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
    out["gaps"] = numbered[-1]["high"] - numbered[0]["low"] + 1 - distinct if numbered else 0
    return out


def ended(live: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(cost, state) of the best end."""
    return min((c + ENDS[t][0], rank, t) for t, (c, rank) in live.items())[::2]


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _repaired_here(conv_id, turns: list[dict], piece: int) -> dict:
    """A whole conversation, seen from its first turn to its last."""
    seen, repeated = set(), set()
    for k, t in enumerate(turns):
        key = (t["role"], t["text"])
        if key in seen:
            repeated.add(k)
        seen.add(key)
    found = faults(turns, repeated)
    pointers, live = layers(found, {NOTHING: (0, 0)})
    cost, state = ended(live)
    codes, tail = traced(pointers, state), ENDS[state][1]
    counts = joined_counts([summary(turns, found)])
    return {"conv_id": conv_id, "piece": piece, "complete": True, **counts, "cost": cost, "audit": "".join(codes) + tail, "turns": edited(turns, codes, NOTHING, tail)}


def _in_pieces(most: int):
    """Sorted rows to pieces: repaired conversations, and blocks of those over ``most`` turns or that may go on in a neighbouring task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held, size, conv_id, opened, out, out_size = [], 0, None, True, [], 0

        def close(last: bool) -> None:
            nonlocal held, size, n
            piece = (part << 32) + n
            out.append({"conv_id": conv_id, "piece": piece, "complete": False, "turns": held} if last or opened else _repaired_here(conv_id, held, piece))
            held, size, n = [], 0, n + 1

        started = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                columns = (batch.column(c).slice(lo, 512).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))
                for c, turn, role, text, gone in zip(*columns, strict=True):
                    if started and c != conv_id:
                        out_size += size
                        close(False)
                        opened = False
                    elif started and (len(held) >= most or size > BLOCK_BYTES):
                        out_size += size
                        opened = True
                        close(False)
                    conv_id, started = c, True
                    if not gone:
                        held.append({"turn": turn, "role": role, "text": text})
                        size += len(text) + 64
                    if out_size > BLOCK_BYTES or len(out) >= 1024:
                        yield _table(out, _PIECE_SCHEMA)
                        out, out_size = [], 0
        if started:
            close(True)
            yield _table(out, _PIECE_SCHEMA)

    return run


_SUMMARY = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("initials", pa.list_(pa.string())), *[(c, pa.int64()) for c in ("low", "high", "distinct")]])
_SUMMARY_DDL = "conv_id long, piece long, costs array<long>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, initials array<string>, low long, high long, distinct long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's cost and rank from every state to every other, -1 where there is no way."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = faults(r["turns"], set(r["repeated"] or ()))
            ends = [layers(found, {s: (0, 0)})[1] for s in range(4)]
            cells = [e.get(t, (-1, -1)) for e in ends for t in range(4)]
            rows.append({"conv_id": r["conv_id"], "piece": r["piece"], "costs": [c for c, _ in cells], "ranks": [k for _, k in cells], **summary(r["turns"], found)})
        yield _table(rows, _SUMMARY)


_DECIDED = pa.schema([("piece", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS]])
_DECIDED_DDL = f"piece long, entry int, exit int, last boolean, {', '.join(f'{c} long' for c in _COUNTS)}"


def _decided(table: pa.Table) -> pa.Table:
    """The states in which each block of one conversation begins and ends, from the blocks' summaries: one row for some 4096 turns."""
    parts = sorted(table.to_pylist(), key=lambda r: r["piece"])
    live, pointers = {NOTHING: (0, 0)}, []
    for p in parts:
        found: dict = {}
        for s, (c, rank) in live.items():
            for t in range(4):
                cost, own = p["costs"][4 * s + t], p["ranks"][4 * s + t]
                if cost >= 0:
                    found[t] = min(found.get(t, (1 << 60,)), (c + cost, rank, own, s))
        order = sorted(found, key=lambda t: found[t][1:3])
        live = {t: (found[t][0], k) for k, t in enumerate(order)}
        pointers.append({t: key[3] for t, key in found.items()})
    cost, state = ended(live)
    counts, rows = joined_counts(parts) | {"cost": cost}, []
    for p, before in zip(parts[::-1], pointers[::-1], strict=True):
        rows.append({"piece": p["piece"], "entry": before[state], "exit": state, "last": not rows, **counts})
        state = before[state]
    return pa.Table.from_batches([_table(rows, _DECIDED)])


def _repaired_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            pointers, _ = layers(faults(r["turns"], set(r["repeated"] or ())), {r["entry"]: (0, 0)})
            codes, tail = traced(pointers, r["exit"]), ENDS[r["exit"]][1] if r["last"] else ""
            row = {c: r[c] for c in ("conv_id", "piece", *_COUNTS)}
            yield _table([row | {"complete": False, "audit": "".join(codes) + tail, "turns": edited(r["turns"], codes, r["entry"], tail)}], _PIECE_SCHEMA)


def repair_conversations(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Repaired pieces of conversations: (conv_id, piece, complete, gaps, blank, duplicate, truncated, illegal, cost, audit, turns).

    ``rows(conv_id, turn, role, text[, gone])``; a row that is ``gone`` only
    shows that its conversation exists. Turns stand in order of their number,
    those without one first, equal ones by role and text. The edits are the
    cheapest after which the initials of roles are ``(s?(ua)+)?``, of equal cost
    those whose letters (delete, insert, keep, rerole) are ASCII-least; blank
    turns and those whose role and text were seen earlier must go. Null roles
    and texts are one space. A null conv_id is a conversation like any other.

    Rows are dealt out by ranges of conversation and turn, so a conversation of
    a third of all rows is spread over tasks. One that lies within a task and a
    block is repaired there and is one piece. Blocks of others tell cost and
    rank between all states; a row a block decides, and the blocks then follow
    their pointers apart. Pieces of a conversation in order of ``piece`` are the
    whole; counts and cost are those of the whole on each of them.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "repair")
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"), gone.alias("gone"))
    keys = ["conv_id", "turn", "role", "text"]
    # equal rows may stand in any order, and the last key lets them be dealt out
    tie = free_name(rows.columns, "tie")
    ordered = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    first = scratch.save(ordered.mapInArrow(_in_pieces(block_turns), _PIECE), "first")
    blocks = first.filter("not complete").select("conv_id", "piece", "turns")
    turns = blocks.select("conv_id", "piece", F.posexplode("turns").alias("pos", "t"))
    earliest = turns.groupBy("conv_id", "t.role", "t.text").agg(F.min(F.struct("piece", "pos")).alias("f")).select("f.piece", "f.pos")
    repeats = turns.select("piece", "pos").join(earliest, ["piece", "pos"], "left_anti").groupBy("piece").agg(F.collect_list("pos").alias("repeated"))
    blocks = scratch.save(blocks.join(repeats, "piece", "left").select("conv_id", "piece", "turns", "repeated"), "blocks")
    decided = blocks.mapInArrow(_summaries, _SUMMARY_DDL).groupBy("conv_id").applyInArrow(_decided, _DECIDED_DDL)
    done = blocks.join(decided, "piece").mapInArrow(_repaired_blocks, _PIECE)
    out = scratch.save(first.filter("complete").unionByName(done), "result")
    scratch.keep_only("result")
    return out


def _hashed(turns: list[dict], before: bool, into) -> None:
    for t in turns:
        into.update(("\n" * before + t["role"] + ":" + t["text"]).encode())
        before = True


_DIGEST = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to a row a conversation; texts pass by, a piece at a time."""
    row, hasher, some, audit = None, None, False, []
    done = lambda: row | {"audit": "".join(audit), "repaired_sha256": hasher.hexdigest()}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if row is None or r["complete"] or row["conv_id"] != r["conv_id"]:
                rows += [done()] if row is not None else []
                row, hasher, some, audit = {c: r[c] for c in ("conv_id", *_COUNTS)}, hashlib.sha256(), False, []
            audit.append(r["audit"])
            _hashed(r["turns"], some, hasher)
            some |= bool(r["turns"])
        yield _table(rows, _DIGEST)
    if row is not None:
        yield _table([done()], _DIGEST)


def repair_digest(pieces: DataFrame) -> DataFrame:
    """A row a conversation, with the SHA-256 of its repaired ``role:text`` lines.

    Only conversations of several pieces are shuffled; one task reads the pieces
    of one in order, as a hash of the whole must, and holds a piece at a time.
    """
    ddl = f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    parted = pieces.filter("not complete").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.filter("complete").mapInArrow(_digests, ddl).unionByName(parted.mapInArrow(_digests, ddl))


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage by crc32(conv_id:turn) % 20: 0 marks a row gone, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("code")
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), code)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", "".join(SENTENCE_ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")
