"""Repair of conversations: the cheapest edits that give every one a legal structure.

A conversation's rows are taken by turn (nulls first; ties by role, the text's first 64
characters and its hash). Each row's first fault counts: blank (only white space),
duplicate (role and text seen earlier), truncated (its last character that is not white
space ends no sentence). A legal structure has role initials ``(s?(ua)+)?``: perhaps a
system message, then users and assistants in turns, an assistant last; or nothing.

Edits cost: Keep 0, Rerole to user or assistant 3, Delete 4 (a must for blank and
duplicate rows), Insert an empty user or assistant message 3; a truncated row that
stays costs 3 more. The cheapest edits are found by a forward Viterbi pass over four
grammar states (nothing yet, after the system message, a user's, an assistant's). Each
state carries its least (cost, audit), where the audit is the edits' initials; each
row's layer is closed by at most two inserts, as more lead back to a state. Of equal
costs the audit that is least in ASCII wins; that holds for whole audits as it does for
their beginnings, for no two edits of one cost and state are beginnings of each other.

How it runs: rows are ordered once by ranges of (conversation, turn), so that a very
long conversation lies in many partitions, and are cut into blocks of ``BLOCK`` rows. A
block's piece of a conversation becomes a table of least (cost, audit) from any state to
any other; tables are put together like matrix products, ``FAN`` at a time. Duplicates
are found by the first place of each (conversation, role, text), with hot ones apart.
Only the writing of a conversation's messages, in order, is one task's work: a stream of
rows of which it holds one batch, and the audit.

Null roles and texts are one blank. Null turns come first, a null id is a conversation of
its own, repeated rows are duplicates of one another, very long texts are taken whole.
An empty table gives no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.graph import attach
from marketloom.llm.storage import discard, staged

#: Rows of a block, as a power of two, and pieces whose tables one task puts together.
BLOCK, FAN = 12, 64
WHITE = " \t\n\x0b\f\r"
KEEP, REROLE, INSERT, DELETE, CUT = 0, 3, 3, 4, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a user's message may follow; an assistant's only follows a user's.
_BEFORE_USER = (NOTHING, SYSTEM, ASSISTANT)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: The least (cost, audit) that leads to each state; None where none does.
Layer = list[tuple[int, str] | None]


def _least(*ways: tuple[int, str] | None) -> tuple[int, str] | None:
    return min((w for w in ways if w is not None), default=None)


def _then(way: tuple[int, str] | None, cost: int, edit: str) -> tuple[int, str] | None:
    return None if way is None else (way[0] + cost, way[1] + edit)


def _closed(layer: Layer) -> Layer:
    """The layer with inserts after it."""
    user = _least(layer[USER], *(_then(layer[s], INSERT, "I") for s in _BEFORE_USER))
    return [layer[NOTHING], layer[SYSTEM], user, _least(layer[ASSISTANT], _then(user, INSERT, "I"))]


def _next(layer: Layer, initial: str, fault: int) -> Layer:
    """The layer after one more row."""
    out = [_then(way, DELETE, "D") for way in layer]
    if fault in (FINE, TRUNCATED):
        more = CUT if fault == TRUNCATED else 0
        before = _least(*(layer[s] for s in _BEFORE_USER))
        user = _then(before, REROLE + more, "R")
        assistant = _then(layer[USER], REROLE + more, "R")
        if initial == "s":
            out[SYSTEM] = _least(out[SYSTEM], _then(layer[NOTHING], KEEP + more, "K"))
        elif initial == "u":
            user = _least(user, _then(before, KEEP + more, "K"))
        elif initial == "a":
            assistant = _least(assistant, _then(layer[USER], KEEP + more, "K"))
        out[USER], out[ASSISTANT] = _least(out[USER], user), _least(out[ASSISTANT], assistant)
    return _closed(out)


def _start(state: int) -> Layer:
    return [(0, "") if s == state else None for s in range(4)]


def _product(a: list[Layer], b: list[Layer]) -> list[Layer]:
    """The table of two pieces, one after the other."""
    return [[_least(*(None if x is None or b[s][t] is None else (x[0] + b[s][t][0], x[1] + b[s][t][1]) for s, x in enumerate(row))) for t in range(4)] for row in a]


_EDGE = "first_initial string, last_initial string, least_turn long, most_turn long, turns long"
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal")
PIECES = f"conv_id long, block long, {', '.join(f'{c} long' for c in _COUNTS)}, {_EDGE}, costs array<long>, audits array<string>"
_LEGAL = {"su", "ua", "au"}


def _schema(ddl: str, conv: T.DataType) -> T.StructType:
    """A schema whose conv_id has the type that the table's has."""
    fields = T.StructType.fromDDL(ddl).fields
    return T.StructType([T.StructField("conv_id", conv) if f.name == "conv_id" else f for f in fields])


def _batch(rows: list[dict], names: list[str], like: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv_id": like, "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "first_initial": pa.string(), "last_initial": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string() if c == "audit" else pa.int64())) for c in names], names=names)


def _piece(conv, block: int, rows: list[tuple], whole: bool) -> dict:
    """What the rows (turn, initial, fault) of one conversation in one block come to."""
    starts = [NOTHING] if whole else range(4)
    table = []
    for state in starts:
        # A piece that doesn't begin its conversation comes after a layer that was closed.
        layer = _closed(_start(state)) if state == NOTHING else _start(state)
        for _, initial, fault in rows:
            layer = _next(layer, initial, fault)
        table += layer
    table += [None] * (16 - len(table))
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "conv_id": conv, "block": block, "rows": len(rows),
        "blank": sum(f == BLANK for *_, f in rows), "duplicate": sum(f == DUPLICATE for *_, f in rows), "truncated": sum(f == TRUNCATED for *_, f in rows),
        "illegal": sum(a[1] + b[1] not in _LEGAL for a, b in zip(rows[:-1], rows[1:], strict=True)),
        "first_initial": rows[0][1], "last_initial": rows[-1][1],
        "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "turns": len(set(turns)),
        "costs": [None if x is None else x[0] for x in table], "audits": [None if x is None else x[1] for x in table],
    }


def _table(piece: dict) -> list[Layer]:
    flat = [None if c is None else (c, a) for c, a in zip(piece["costs"], piece["audits"], strict=True)]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def _together(a: dict, b: dict) -> dict:
    table = _product(_table(a), _table(b))
    flat = [x for row in table for x in row]
    both = [x for x in (a["least_turn"], b["least_turn"]) if x is not None], [x for x in (a["most_turn"], b["most_turn"]) if x is not None]
    return {
        "conv_id": a["conv_id"], "block": a["block"], **{c: a[c] + b[c] for c in _COUNTS[:-1]},
        "illegal": a["illegal"] + b["illegal"] + (a["last_initial"] + b["first_initial"] not in _LEGAL),
        "first_initial": a["first_initial"], "last_initial": b["last_initial"],
        "least_turn": min(both[0], default=None), "most_turn": max(both[1], default=None),
        # Turns are in order, so pieces share one at most.
        "turns": a["turns"] + b["turns"] - (a["most_turn"] is not None and a["most_turn"] == b["least_turn"]),
        "costs": [None if x is None else x[0] for x in flat], "audits": [None if x is None else x[1] for x in flat],
    }


def ordered(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` in order, with their places; written to the shared folder."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    trimmed = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumns(
        {
            "initial": F.left("role", F.lit(1)),
            "fault": F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED),
            "same": F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(" "), F.length("role").cast("string"), F.lit(" "), "role", "text")),
        }
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)), F.left("text", F.lit(64)), F.xxhash64("role", "text")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Ranges have rising numbers, and so have the rows in them.
    return staged(rows.withColumn("place", F.monotonically_increasing_id()), "turns")


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each conversation's part in each block of ``rows`` (conv_id, place, turn, initial, fault)."""
    conv = rows.schema["conv_id"].dataType
    schema = _schema(PIECES, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name, began = None, True  # of the run that is held; whether it begins its block

        def close(last: bool) -> dict:
            return _piece(name[1], name[0], held, not began and not last)

        out, like = [], None
        for batch in batches:
            like = batch.schema.field("conv_id").type
            for block, conv_id, *row in zip(*(batch[c].to_pylist() for c in ("block", "conv_id", "turn", "initial", "fault")), strict=True):
                if name != (block, conv_id):
                    if held:
                        out.append(close(name[0] != block))
                    began = name is None or name[0] != block
                    name, held = (block, conv_id), []
                held.append(tuple(row))
            if out:
                yield _batch(out, schema.names, like)
                out = []
        if held:
            yield _batch([close(True)], schema.names, like)

    at = rows.withColumn("block", F.shiftright("place", BLOCK)).repartition("block").sortWithinPartitions("block", "place")
    return at.mapInArrow(run, schema)


def _folded(pieces: DataFrame, by: int) -> DataFrame:
    """Pieces put together, those of one conversation in 2 ** ``by`` neighbouring blocks; with 64 all of a conversation."""
    schema = _schema(PIECES, pieces.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, like = None, None
        for batch in batches:
            out, like = [], batch.schema.field("conv_id").type
            for piece in batch.to_pylist():
                group = piece.pop("group")
                if held is not None and (held[0], held[1]["conv_id"]) == (group, piece["conv_id"]):
                    held = (group, _together(held[1], piece))
                else:
                    if held is not None:
                        out.append(held[1])
                    held = (group, piece)
                held[1]["block"] = held[0]
            if out:
                yield _batch(out, schema.names, like)
        if held is not None:
            yield _batch([held[1]], schema.names, like)

    # The order must be that of the blocks, which a group's number replaces afterwards.
    group = F.lit(0).cast("long") if by > 62 else F.shiftright("block", by)
    at = pieces.withColumn("group", group).repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "block")
    return at.mapInArrow(run, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit; and the ordered rows that ``repaired`` needs."""
    rows = ordered(turns)
    firsts = attach(rows.select("conv_id", "place", "turn", "initial", "fault", "same"), "same", rows.count(), F.min("place").alias("first"))
    again = (F.col("fault") != BLANK) & (F.col("place") > F.col("first"))
    pieces = _pieces(firsts.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault"))))
    pieces = staged(pieces, "pieces")
    while (pieces.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > FAN:
        more = staged(_folded(pieces, FAN.bit_length() - 1), "pieces")
        discard(pieces)
        pieces = more
    whole = _folded(pieces, 64)
    # From no message yet to no message or an assistant's, which are the places 0 and 3 of the table.
    ends = F.array_min(F.filter(F.array(*(F.struct(F.get("costs", F.lit(k)).alias("cost"), F.get("audits", F.lit(k)).alias("audit")) for k in (NOTHING, ASSISTANT))), lambda e: e["cost"].isNotNull()))
    span = F.col("most_turn").cast("decimal(20,0)") - F.col("least_turn") + 1 - F.col("turns")
    report = whole.withColumn("end", ends).select(
        "conv_id", F.coalesce(span.try_cast("long"), F.lit(0).cast("long")).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"),
    )
    report = staged(report, "repairs")
    discard(pieces)
    return report, rows


def repaired(report: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, position, role and text of the repaired messages; each conversation's in order within a partition."""
    null = F.lit(None).cast("string")
    told = report.select("conv_id", F.lit(-1).cast("long").alias("place"), null.alias("role"), null.alias("text"), "audit")
    both = rows.select("conv_id", "place", "role", "text", null.alias("audit")).unionByName(told)
    conv = rows.schema["conv_id"].dataType
    schema = _schema("conv_id long, position long, role string, text string", conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, position, state = "", 0, 0, NOTHING
        for batch in batches:
            out: list[tuple] = []

            def put(conv_id, role: str, text: str, to: int) -> None:
                nonlocal position, state
                out.append((conv_id, position, role, text))
                position, state = position + 1, to

            def inserts(conv_id) -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put(conv_id, *(("assistant", "", ASSISTANT) if state == USER else ("user", "", USER)))
                    at += 1

            for conv_id, place, role, text, own in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text", "audit")), strict=True):
                if place < 0:
                    audit, at, position, state = own, 0, 0, NOTHING
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        put(conv_id, role, text, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]])
                    elif edit == "R":
                        put(conv_id, *(("assistant", text, ASSISTANT) if state == USER else ("user", text, USER)))
                inserts(conv_id)
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def digests(messages: DataFrame) -> DataFrame:
    """conv_id and the hex sha256 of its ``role:text`` lines, of messages that come in order within their partitions."""
    schema = _schema("conv_id long, repaired_sha256 string", messages.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = None, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for conv_id, position, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if held is not None:
                        done.append((held[0], held[1].hexdigest()))
                    held = (conv_id, hashlib.sha256())
                held[1].update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=schema.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([held[1].hexdigest()], pa.string())], names=schema.names)

    return messages.mapInArrow(run, schema)
