"""Which windows of fixed length occur more than once: the part that bytes and words have in common.

Every window of `unit` symbols owns one anchor: the least of the hashes of its runs of `gram` symbols
(the first of equal ones). Where a window is, and what surrounds it, plays no part, so equal
windows have equal anchors. Neighbouring windows of the same anchor form a segment; each window
start belongs to exactly one segment, and there is about one for every unit / 2 symbols.

    anchors met once                      none of their windows repeats
    anchors that always have one content  all of their windows repeat (solid)
    the others (mixed)                    what differs must be looked at window by window

Anchors are counted by Spark with partial sums; a bit table of fixed size then tells the second
pass which segments are worth shuffling. Contents are compared by two 64-bit hashes (anchor and
content).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.llm.bits import bit_table, member
from musterline.llm.tables import written
from musterline.llm.words import _BYTE, document_words, mixed, powers, runs_hash, text_bytes

_CHUNK = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
_CONTENT = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Segments:
    """First window, windows, anchor hash and content hash of each segment."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _least_place(keys: np.ndarray, width: int) -> np.ndarray:
    """The place of the least key in every run of `width`, the first of equal ones."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = (keys & ~_PLACE) | np.arange(n, dtype=np.uint64)
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & _PLACE).astype(np.int64)


def _within(h: np.ndarray, at: np.ndarray, unit: int, gram: int) -> Segments:
    """Of texts that lie one after the other in h; text i begins at at[i], and no window leaves its text."""
    grams = runs_hash(h, gram)
    place = _least_place(grams, unit - gram + 1)
    inside = np.zeros(len(h) + 1, np.int32)
    size = np.diff(at)
    long = size >= unit
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - unit + 1, -1)
    valid = np.cumsum(inside)[: len(place)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    new[at[:-1][long]] = True
    first = np.flatnonzero(new)
    count = np.bincount(np.cumsum(new)[valid] - 1, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_CONTENT, len(h)), out=total[1:])
    down = powers(pow(_CONTENT, -1, 1 << 64), len(h))
    content = mixed((total[first + count + unit - 1] - total[first]) * down[first] + count.astype(np.uint64))
    return Segments(first, count, grams[place[first]], content)


def segments(h: np.ndarray, at: np.ndarray, unit: int, gram: int) -> Segments:
    """Of texts of symbol hashes h that begin at at[:-1]; a text longer than a chunk stands alone."""
    n = len(h)
    if n < unit:
        return Segments(*(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.uint64)))
    if n <= 2 * _CHUNK or len(at) > 2:
        return _within(h, at, unit, gram)
    out, lo = [], 0
    while True:
        part = h[lo : lo + _CHUNK + unit]
        s = _within(part, np.array([0, len(part)]), unit, gram)
        if lo + len(part) == n:
            out.append(Segments(s.start + lo, s.count, s.anchor, s.content))
            break
        # The last segment may go on: the next chunk begins with it.
        out.append(Segments(s.start[:-1] + lo, s.count[:-1], s.anchor[:-1], s.content[:-1]))
        lo += int(s.start[-1])
    return Segments(*(np.concatenate([getattr(s, x) for s in out]) for x in ("start", "count", "anchor", "content")))


@dataclass(frozen=True)
class Block:
    """Neighbouring texts: their rows, where each begins, their symbols (word hashes or bytes), segments and the text of each segment."""

    rows: np.ndarray
    at: np.ndarray
    symbols: np.ndarray
    found: Segments
    owner: np.ndarray


@dataclass(frozen=True)
class Kind:
    """What symbols are: UTF-8 bytes or words."""

    unit: int
    gram: int
    words: bool

    def _block(self, rows: list[int], parts: list[np.ndarray]) -> Block:
        at = np.cumsum([0] + [len(p) for p in parts])
        h = np.concatenate(parts)
        found = segments(h, at, self.unit, self.gram)
        return Block(np.array(rows), at, h, found, np.searchsorted(at, found.start, side="right") - 1)

    def blocks(self, column: pa.Array) -> Iterator[Block]:
        """The texts that have windows."""
        if self.words:
            rows, parts, size = [], [], 0
            for row, _, _, _, h in document_words(column):
                if len(h) < self.unit:
                    continue
                if size + len(h) > _CHUNK and size:
                    yield self._block(rows, parts)
                    rows, parts, size = [], [], 0
                rows.append(row)
                parts.append(h)
                size += len(h)
            if size:
                yield self._block(rows, parts)
        else:
            data, at = text_bytes(column)
            lo = 0
            while lo < len(at) - 1:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _CHUNK, side="right")) - 1)
                text = data[at[lo] : at[hi]]
                own = at[lo : hi + 1] - at[lo]
                found = segments(_BYTE[text], own, self.unit, self.gram)
                yield Block(np.arange(lo, hi), own, text, found, np.searchsorted(own, found.start, side="right") - 1)
                lo = hi


def _longs(x: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))


def _count(kind: Kind):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kind.blocks(batch.column("text")):
                yield pa.record_batch([_longs([block.found.anchor]), _longs([block.found.content])], names=["anchor", "content"])

    return task


_FOUND = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("payload", pa.binary())])
FOUND = "doc_id long, row_key long, start long, count long, anchor long, content long, payload binary"


def _find(kind: Kind, payloads, tables):
    """Segments of repeated anchors, with what is needed to look into the mixed ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kind.blocks(batch.column("text")):
                s = block.found
                at = np.flatnonzero(member(tables.value["repeated"], s.anchor))
                if not len(at):
                    continue
                start, count, anchor, owner = s.start[at], s.count[at], s.anchor[at], block.owner[at]
                inside = member(tables.value["mixed"], anchor)
                loads = np.full(len(at), None, object)
                loads[inside] = payloads(block, start[inside].tolist(), count[inside].tolist())
                own = batch.select(["doc_id", "row_key"]).take(pa.array(block.rows[owner]))
                yield pa.record_batch([own.column(0), own.column(1), *(_longs([x]) for x in (start - block.at[owner], count, anchor, s.content[at])), pa.array(loads, pa.binary())], schema=_FOUND)

    return task


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row_key"))


@dataclass(frozen=True)
class Found:
    """solid: segments whose windows all repeat. mixed: the others, of anchors with several contents.

    contents: one row for each anchor and content of the mixed ones: occurrences n, count, payload.
    """

    solid: DataFrame
    mixed: DataFrame
    contents: DataFrame


def find(texts: DataFrame, kind: Kind, payloads: Callable, name: str) -> Found:
    """Segments of texts (doc_id, row_key, text) whose anchors occur more than once."""
    spark = texts.sparkSession
    anchors = texts.select("text").mapInArrow(_count(kind), "anchor long, content long")
    anchors = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    anchors = written(anchors.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("is_mixed")), f"{name}-anchors")
    tables = spark.sparkContext.broadcast({"repeated": bit_table(anchors.select("anchor")), "mixed": bit_table(anchors.where("is_mixed").select("anchor"))})
    found = texts.mapInArrow(_find(kind, payloads, tables), FOUND)
    found = written(found.join(anchors, "anchor").withColumn("payload", F.when(F.col("is_mixed"), F.col("payload"))), f"{name}-found")
    inside = found.where("is_mixed")
    contents = inside.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.first("count").alias("count"), F.first("payload").alias("payload"))
    return Found(found.where("not is_mixed").select("doc_id", "row_key", "start", "count", "anchor"), inside.drop("payload"), written(contents, f"{name}-contents"))


RUN = "anchor long, content long, from long, edges long"
_RUN = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("from", pa.int64()), ("edges", pa.int64())])
SINGLE = "anchor long, content long, place long, window long, n long"


def _runs(look: Callable):
    """Runs of repeated windows in each content, shard by shard: rows come sorted by shard, and a shard has all contents of its anchors."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, content, n, count = (table.column(x).to_numpy() for x in ("anchor", "content", "n", "count"))
        hit = look(anchor, n, count, table.column("payload").to_pylist())
        begin = np.append(0, np.cumsum(count + 1))  # a gap behind each content
        line = np.zeros(begin[-1] + 1, np.int8)
        line[np.arange(int(count.sum())) + np.repeat(np.arange(len(count)), count) + 1] = hit | np.repeat(n > 1, count)
        edge = np.diff(line)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(begin, a, side="right") - 1
        return pa.record_batch([pa.array(anchor[row]), pa.array(content[row]), pa.array(a - begin[row]), pa.array(b - a)], schema=_RUN)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and shard[a] != now:
                    yield settle(held)
                    held = []
                held.append(batch.slice(a, b - a))
                now = shard[a]
        if held:
            yield settle(held)

    return task


def resolve(contents: DataFrame, look: Callable, split: Callable, shard: int, crowd: int, name: str) -> DataFrame:
    """(anchor, content, from, edges): runs of windows that occur in several places.

    Contents are dealt into shards of about `shard` bytes by anchor, many of them in each of Spark's shuffle
    partitions, and look(anchor, n, count, payloads) says for all windows of a shard whether they repeat. An anchor of more than `crowd`
    contents would crowd a shard: split, a task, turns its contents into rows by window, and Spark counts those.
    """
    each = contents.groupBy("anchor").agg(F.count("*").alias("contents"))
    crowded = written(each.where(f"contents > {crowd}").select("anchor"), f"{name}-crowded")
    whole = contents.agg(F.sum(F.length("payload"))).first()[0] or 0
    n = max(1, whole // shard)
    dealt = contents.join(crowded, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    runs = dealt.mapInArrow(_runs(look), RUN)
    single = written(contents.join(crowded, "anchor", "left_semi").mapInArrow(split, SINGLE), f"{name}-windows")
    seen = single.groupBy("anchor", "window").agg(F.sum("n").alias("met")).where("met > 1").drop("met")
    more = single.join(seen, ["anchor", "window"]).select("anchor", "content", F.col("place").alias("from"), F.lit(1).cast("long").alias("edges"))
    return written(runs.unionByName(more), f"{name}-runs")


def ranges(found: Found, runs: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, count): all window starts that repeat."""
    branching = found.mixed.join(runs, ["anchor", "content"]).select("doc_id", "row_key", (F.col("start") + F.col("from")).alias("start"), F.col("edges").alias("count"))
    return found.solid.drop("anchor").unionByName(branching)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted disjoint [from, to) ranges; those that touch become one."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(ranges) - 1)
    return np.stack([ranges[new, 0], end[last]], 1)


def _cut(kind: Kind):
    """Each text without what its ranges of window starts cover."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            starts, counts = batch.column("starts"), batch.column("counts")
            size, removed, spans, digest = [], [], [], []
            for row in range(batch.num_rows):
                text = data[at[row] : at[row + 1]].tobytes()
                unit = text.split() if kind.words else text
                gone = np.zeros((0, 2), np.int64)
                if starts[row].is_valid and len(starts[row]):
                    s, c = (np.asarray(x[row].values) for x in (starts, counts))
                    gone = merged(np.stack([s, s + c + kind.unit - 1], 1))
                size.append(len(unit))
                removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                spans.append(len(gone))
                edge = [0, *gone.reshape(-1).tolist(), len(unit)]
                kept = [unit[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2)]
                kept = b" ".join(w for part in kept for w in part) if kind.words else b"".join(kept)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest)], names=["doc_id", "n", "n_removed", "n_spans", "kept_sha256"])

    return task


def gathered(ranges: DataFrame) -> DataFrame:
    """All distinct ranges of window starts of one text in one row: as many as the text has segments at most, however often its row is repeated."""
    return ranges.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "count")).alias("r")).select("doc_id", "row_key", F.col("r.start").alias("starts"), F.col("r.count").alias("counts"))


def cut(texts: DataFrame, ranges: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256) of every text."""
    own = gathered(ranges).withColumnsRenamed({"doc_id": "d", "row_key": "k"})
    met = texts.join(own, F.expr("row_key = k and doc_id <=> d"), "left").select("doc_id", "text", "starts", "counts")
    return met.mapInArrow(_cut(kind), "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string")
