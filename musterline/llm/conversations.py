"""Repair of conversation structure by cheapest edits.

A conversation should read system?, then user and assistant in turn. Every row is kept, given another role, or
deleted, and rows may be inserted; the cheapest edits are a shortest path through a lattice of rows and
what was said last, found by an auction (`auction`). Of equally cheap edits, those whose initials are least
in ASCII are traced along the tight arcs.

Rows are laid out in order of conversation and turn by range, so a conversation of any length is a
run of neighbouring rows, in several partitions if it is long. A task solves each conversation it
holds whole, in blocks of BLOCK rows; for the piece of one that goes on elsewhere it finds the best edits from every
state to every state, and pieces are joined by another auction over these. Only counts, prices and initials
meet; texts pass once more, in order, to be edited and hashed as they stream by. SHA-256 of a whole
conversation is a chain, so that last pass takes a conversation in one task, holding one row at a time.

Nulls: a null role or text is one space, a null turn comes first, a null conv_id is a conversation.
Rows of one turn are ordered by role, then text. Repeated rows are duplicates. An empty role is no
role of the pattern. Very long texts are only hashed. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.llm.auction import Arcs, cheapest
from musterline.llm.tables import written

BLOCK = 64

# --- fixed values: costs of edits, and what may follow in a conversation -----------------
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = {"u": "user", "a": "assistant"}
NOTHING, SYSTEM, USER, ASSISTANT, END = range(5)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_LEGAL = {"su", "ua", "au"}
_STATES = 4

FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
Row = tuple[str, int]  # initial of the role, fault
Best = dict[tuple[int, int], tuple[int, str]]  # from state, to state: cost, initials


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults that follow from crc32 of `conv_id:turn`."""
    spaced = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return spaced.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


# The lattice


def _lattice(rows: list[Row], inserts_behind: bool, states: int = _STATES) -> tuple[Arcs, list[float]]:
    """Node 4 i + q: i rows are edited and state q is reached. Prices: what the rows still to come cost at least."""
    arcs: Arcs = []
    for i in range(len(rows) + 1):
        last = i == len(rows)
        for q in range(_STATES):
            out = []
            if not last:
                initial, fault = rows[i]
                out.append((DELETE, "D", 4 * i + 4 + q))
                if fault in (FINE, CUT_OFF):
                    more = TRUNCATED if fault == CUT_OFF else 0
                    for said, to in NEXT[q].items():
                        if to >= states:
                            continue
                        if said == initial:
                            out.append((more, "K", 4 * i + 4 + to))
                        elif said in ROLES:
                            out.append((REROLE + more, "R", 4 * i + 4 + to))
            if not last or inserts_behind:
                out += [(INSERT, "I", 4 * i + to) for said, to in NEXT[q].items() if said in ROLES and to < states]
            arcs.append(out)
    price, left = [0.0] * len(arcs), 0.0
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        left += DELETE if fault else (0 if initial in ("s", "u", "a") else REROLE)
        price[4 * i : 4 * i + 4] = [left] * 4
    return arcs, price


def _closed(arcs: Arcs, price: list[float]) -> int:
    """One more node, the end, behind the last states that a conversation may end in."""
    end = len(arcs)
    for q in (NOTHING, ASSISTANT):
        arcs[end - _STATES + q].append((0, "", end))
    arcs.append([])
    price.append(0.0)
    return end


def _chain(parts: list[Best], ended: bool) -> tuple[Arcs, list[float]]:
    """The same lattice with a whole piece in place of a row."""
    arcs: Arcs = [[(cost, label, 4 * i + 4 + to) for (q, to), (cost, label) in part.items() if q == at] for i, part in enumerate(parts) for at in range(_STATES)]
    arcs += [[(INSERT, "I", 4 * len(parts) + to) for said, to in NEXT[q].items() if said in ROLES] if ended else [] for q in range(_STATES)]
    price, left = [0.0] * len(arcs), 0.0
    for i in range(len(parts) - 1, -1, -1):
        left += min(cost for cost, _ in parts[i].values())
        price[4 * i : 4 * i + 4] = [left] * 4
    return arcs, price


def _open(rows: list[Row]) -> Best:
    """The best edits of a piece between any two states. What opens a conversation is not reached from behind it."""
    best: Best = {}
    for to in range(_STATES):
        arcs, price = _lattice(rows, False, to + 1 if to < USER else _STATES)
        for at in range(_STATES):
            if (at <= to if to < USER else True) and (found := cheapest(arcs, price, at, 4 * len(rows) + to)):
                best[at, to] = found
    return best


def _joined(parts: list[Best]) -> Best:
    if len(parts) == 1:
        return parts[0]
    arcs, price = _chain(parts, False)
    pairs = [(at, to) for at in range(_STATES) for to in range(_STATES) if at <= to or at > SYSTEM < to]
    return {(at, to): found for at, to in pairs if (found := cheapest(arcs, price, at, 4 * len(parts) + to))}


def _whole(parts: list[Best]) -> tuple[int, str]:
    arcs, price = _chain(parts, True)
    return cheapest(arcs, price, NOTHING, _closed(arcs, price))


def solve(rows: list[Row]) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a whole conversation."""
    if len(rows) > 2 * BLOCK:
        return _whole([_open(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])
    arcs, price = _lattice(rows, True)
    return cheapest(arcs, price, NOTHING, _closed(arcs, price))


def between(rows: list[Row]) -> Best:
    """The best edits of a piece of a conversation between any two states."""
    parts = [_open(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
    step = max(2, BLOCK)
    while len(parts) > 1:
        parts = [_joined(parts[i : i + step]) for i in range(0, len(parts), step)]
    return parts[0]


# Pieces of conversations

_NAMES = ("conv_id", "start", "rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns", "best")
_BEST = pa.list_(pa.struct([("at", pa.int8()), ("to", pa.int8()), ("cost", pa.int64()), ("edits", pa.string())]))
_PIECES = pa.schema([(n, _BEST if n == "best" else pa.string() if n in ("first", "last") else pa.int64()) for n in _NAMES])
_PIECE_COLUMNS = ", ".join(f"{n} {'array<struct<at:byte,to:byte,cost:long,edits:string>>' if n == 'best' else 'string' if n in ('first', 'last') else 'long'}" for n in _NAMES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Piece:
    """Neighbouring rows of one conversation as they stream by."""

    def __init__(self, conv_id, start: int, opened: bool):
        self.conv_id, self.start, self.opened = conv_id, start, opened
        self.rows: list[Row] = []
        self.last = None
        self.turns, self.least, self.most = 0, None, None

    def take(self, turn, initial: str, key: str, fault: int) -> None:
        same = self.last == (turn, key)
        if same and fault != BLANK:
            fault = DUPLICATE
        if turn is not None:
            self.turns += self.most != turn
            self.least, self.most = turn if self.least is None else self.least, turn
        self.rows.append((initial, fault))
        self.last = turn, key

    def row(self, closed: bool) -> tuple:
        faults = [f for _, f in self.rows]
        illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(self.rows, self.rows[1:]))
        if self.opened and closed:
            best = {(NOTHING, END): solve(self.rows)}
        else:
            best = between(self.rows)
        told = [{"at": a, "to": b, "cost": c, "edits": e} for (a, b), (c, e) in best.items()]
        return (self.conv_id, self.start, len(faults), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), illegal, self.rows[0][0], self.rows[-1][0], self.least, self.most, self.turns, told)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of rows of a conversation whose places follow one another."""
    out: list[tuple] = []
    piece, place = None, None
    for batch in batches:
        for conv_id, at, turn, initial, key, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            follows = place is not None and at == place + 1
            if piece is None or not follows or piece.conv_id != conv_id:
                if piece is not None:
                    out.append(piece.row(closed=follows))
                piece = _Piece(conv_id, at, opened=follows)
            piece.take(turn, initial, key, fault)
            place = at
        if len(out) >= 1000:
            yield _batch(out, _PIECES)
            out = []
    if piece is not None:
        out.append(piece.row(closed=False))
    if out:
        yield _batch(out, _PIECES)


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SOLVED = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in _TOTALS), ("audit", pa.string())])
_SOLVED_COLUMNS = f"conv_id long, {', '.join(f'{n} long' for n in _TOTALS)}, audit string"


def _solved(pieces: list[dict]) -> tuple:
    conv_id, pieces = pieces[0]["conv_id"], [p for p in pieces if p["rows"]]
    if not pieces:
        return (conv_id, *[0] * len(_TOTALS), "")
    added = {n: sum(p[n] for p in pieces) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
    most = None
    for before, p in zip([None, *pieces], pieces):
        if before is not None:
            added["illegal"] += before["last"] + p["first"] not in _LEGAL
        if p["least"] is not None:
            added["turns"] -= p["least"] == most
            most = p["most"]
    least = next((p["least"] for p in pieces if p["least"] is not None), None)
    gaps = 0 if most is None else most - least + 1 - added["turns"]
    found = [{(b["at"], b["to"]): (b["cost"], b["edits"]) for b in p["best"]} for p in pieces]
    cost, audit = found[0].get((NOTHING, END)) or _whole(found)
    return conv_id, gaps, added["blank"], added["duplicate"], added["truncated"], added["illegal"], cost, audit


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    own: list[dict] = []
    for batch in batches:
        for piece in batch.to_pylist():
            if own and own[0]["conv_id"] != piece["conv_id"]:
                out.append(_solved(own))
                own = []
            own.append(piece)
        if len(out) >= 1000:
            yield _batch(out, _SOLVED)
            out = []
    if own:
        out.append(_solved(own))
    if out:
        yield _batch(out, _SOLVED)


# Editing


class Editor:
    """Follows the initials of edits and says what becomes of each row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _say(self, initial: str) -> None:
        self.state = NEXT[self.state][initial]

    def inserted(self) -> Iterator[str]:
        """Roles of the rows inserted here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            initial = "a" if self.state == USER else "u"
            self._say(initial)
            yield ROLES[initial]

    def row(self, role: str) -> str | None:
        """The role a row gets, None if it goes."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        initial = role[:1] if edit == "K" else "a" if self.state == USER else "u"
        self._say(initial)
        return role if edit == "K" else ROLES[initial]


def _edited(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows, an audit in front of each conversation, to repaired rows or to digests."""
    schema = _DIGESTS if digest else _REPAIRED
    out: list[tuple] = []
    state: dict = {}

    def say(role: str, text: str, edit: str) -> None:
        if digest:
            state["hash"].update((("\n" if state["n"] else "") + role + ":" + text).encode())
        else:
            out.append((state["conv_id"], state["n"], role, text, edit))
        state["n"] += 1

    def close() -> None:
        for role in state["editor"].inserted():
            say(role, "", "I")
        if digest:
            out.append((state["conv_id"], state["hash"].hexdigest()))

    for batch in batches:
        for conv_id, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text")), strict=True):
            if at < 0:
                if state:
                    close()
                state = {"conv_id": conv_id, "editor": Editor(text), "n": 0, "hash": hashlib.sha256()}
                continue
            editor = state["editor"]
            for new in editor.inserted():
                say(new, "", "I")
            edit = editor.audit[editor.at]
            new = editor.row(role)
            if new is not None:
                say(new, text, edit)
        if len(out) >= 1000:
            yield _batch(out, schema)
            out.clear()
    if state:
        close()
    if out:
        yield _batch(out, schema)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


@dataclass(frozen=True)
class Repair:
    """totals: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. in_order: rows with audits in front."""

    totals: DataFrame
    in_order: DataFrame

    def rows(self) -> DataFrame:
        """The repaired conversations: conv_id, place, role, text, edit."""
        return self.in_order.mapInArrow(lambda b: _edited(b, False), "conv_id long, place long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """SHA-256 of each repaired conversation, `role:text` joined by line ends."""
        return self.in_order.mapInArrow(lambda b: _edited(b, True), "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> Repair:
    """Cheapest repair of rows (conv_id, turn, role, text). `conversations` (conv_id) may name ones without rows."""
    texts = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    own = texts.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # Only texts that come in two turns of a conversation have rows here; equal rows of one turn are neighbours below.
    again = own.groupBy("conv_id", "key").agg(F.min(when).alias("soonest"), F.max(when).alias("latest")).where("soonest <> latest")
    again = written(again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "soonest"), "conv-again")
    met = own.join(again, own["key"].eqNullSafe(again["k"]) & own["conv_id"].eqNullSafe(again["c"]), "left")
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", BLANK).when(F.coalesce(F.col("soonest") < when, F.lit(False)), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = met.select(*order, "key", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = written(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "conv-rows")

    pieces = laid.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), "key", "fault").mapInArrow(_pieces, _PIECE_COLUMNS)
    named = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long")).distinct()
    none = named.select("conv_id", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("rows"), *(F.lit(None).cast(pieces.schema[n].dataType).alias(n) for n in _NAMES[3:]))
    gathered = pieces.unionByName(none).repartition("conv_id").sortWithinPartitions("conv_id", "start")
    totals = written(gathered.mapInArrow(_put_together, _SOLVED_COLUMNS), "conv-totals")
    audits = totals.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    in_order = laid.select("conv_id", "at", "role", "text").unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return Repair(totals, in_order)
