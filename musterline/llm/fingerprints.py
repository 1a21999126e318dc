"""Fingerprints by Lempel-Ziv phrases.

A text is parsed into LZ78 phrases: each is the shortest string from where the last one ended that is
not a phrase yet. Texts that compress well together have many phrases in common, so the
similarity of two phrase sets is like that of compressed sizes, without compressing pairs. A
fingerprint is the MinHash signature of the phrase set: SIZE least hashes of 16 bits, in
hexadecimal. The likeness of two fingerprints is the share of places where they agree.

`edited` compares every text with an edited one and with the next document. Documents are put in
descending order of ID (null last; equal IDs by a hash of the text) by ranges, so that a task
sees neighbours one after the other; only the first and last row of each range meet outside.
An edited text shares two thirds of its parse with its original, which is done once.

A null or empty text has no phrases, and all fingerprints of no phrases are equal (likeness 1).
Repeated rows are documents of their own. One document alone is its own next. Texts are parsed whole, however long.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from musterline.llm.tables import parts, written
from musterline.llm.words import mixed, powers

SIZE = 128
_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def parse(text: str, seen: set[str], at: int, until: int) -> list[int]:
    """Ends of the phrases from `at` on that end by `until`; they are added to `seen`.

    Every beginning of a phrase is a phrase, so the search starts from the length of the last one.
    """
    ends, size = [], 1
    while at < until:
        while at + size <= until and text[at : at + size] in seen:
            size += 1
        while size > 1 and text[at : at + size - 1] not in seen:
            size -= 1
        if at + size > until:
            break
        seen.add(text[at : at + size])
        at += size
        ends.append(at)
    return ends


def signature(text: str, ends: list[int]) -> np.ndarray:
    """SIZE 16-bit numbers from the phrases between 0 and the ends."""
    least = np.full(SIZE, (1 << 32) - 1, np.uint64)
    if ends:
        codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(_BASE, len(codes)), out=total[1:])
        end = np.array(ends)
        begin = np.append(0, end[:-1])
        h = mixed((total[end] - total[begin]) * powers(pow(_BASE, -1, 1 << 64), len(codes))[begin] + (end - begin).astype(np.uint64))
        for lo in range(0, len(h), 2048):
            least = np.minimum(least, ((h[lo : lo + 2048, None] * _ODD) >> np.uint64(32)).min(0))
    return least.astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, next_text: str) -> str:
    """The last third replaced by as much of the next text's beginning, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + next_text[:third]


def _both(text: str, next_text: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Signature of a text, its edited text, and that one's signature."""
    cut = len(text) - len(text) // 3
    seen: set[str] = set()
    ends = parse(text, seen, 0, cut)
    at = ends[-1] if ends else 0
    tail = parse(text, seen, at, len(text))
    own = signature(text, ends + tail)
    for a, b in zip([at, *tail], tail, strict=False):
        seen.discard(text[a:b])
    other = edited(text, next_text)
    return own, other, signature(other, ends + parse(other, seen, at, len(other)))


_ROW = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("own", pa.binary()), ("other", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_text", pa.string()), ("last_text", pa.string())])
_SCHEMA = "part long, doc_id long, n_chars long, edited_sha256 string, own binary, other binary, near_edited double, near_next double, first_text string, last_text string"


def _finished(text: str, next_text: str) -> tuple:
    own, other_text, other = _both(text, next_text)
    return len(text), hashlib.sha256(other_text.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; the last of the range still lacks its next."""
    part, first, held, waiting = TaskContext.get().partitionId(), True, [], None

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), _ROW.types, strict=True)], schema=_ROW)

    before = None  # the row whose likeness to the next is still open
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if waiting is not None:
                row = _finished(waiting[1], text)
                own = row[2]
                if before is not None:
                    held.append((*before, likeness(before_own, own), None if not first_open else first_text, None))
                    first_open = False
                before, before_own = (part, waiting[0], row[0], row[1], row[2].tobytes(), row[3].tobytes(), row[4]), own
            else:
                first_text, first_open = text, True
            waiting = (doc_id, text)
            if len(held) == 1000:
                yield out()
                held = []
    if waiting is not None:
        seen: set[str] = set()
        own = signature(waiting[1], parse(waiting[1], seen, 0, len(waiting[1])))
        if before is not None:
            held.append((*before, likeness(before_own, own), first_text if first_open else None, None))
            first_open = False
        held.append((part, waiting[0], len(waiting[1]), None, own.tobytes(), None, None, None, first_text if first_open else None, waiting[1]))
        yield out()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of ranges, with the first text and signature of the next range."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            n, digest, own, other, near = _finished(r["last_text"], r["next_text"])
            rows.append((r["part"], r["doc_id"], n, digest, own.tobytes(), other.tobytes(), near, likeness(own, np.frombuffer(r["next_own"], np.uint16)), None, None))
        if rows:
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _ROW.types, strict=True)], schema=_ROW)


def compare_edited(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the fingerprints and likenesses of each text and its edited text."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row_key"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("row_key")]
    ranges = texts.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = written(ranges.select("doc_id", "text").mapInArrow(_ranges, _SCHEMA), "fingerprints")

    # One first and one last row for each range that has any; the range after the last is the first.
    firsts = rows.where("first_text is not null").select("part", F.col("first_text").alias("next_text"), F.col("own").alias("next_own"))
    lasts = rows.where("last_text is not null").select("part", "doc_id", "last_text")
    around = firsts.select("part", F.expr("coalesce(lag(part) over (order by part), max(part) over ())").alias("before"), "next_text", "next_own")
    ends = lasts.join(around.drop("part").withColumnRenamed("before", "part"), "part").select("part", "doc_id", "last_text", "next_text", "next_own")
    every = rows.where("last_text is null").unionByName(ends.mapInArrow(_ends, _SCHEMA))
    return every.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("other")).alias("edited_fingerprint"), "near_edited", "near_next"
    )
