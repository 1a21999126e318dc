"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Only text around repeated anchors (see repeats.py) can hold a repeated string of `unit` bytes, and
where an anchor has one content only, all of its windows repeat. What remains are the
different contents of one anchor, each once: these go into shards by anchor, so all
strings that may be equal meet in one shard. A shard's suffix array is induced: suffixes are
classified as smaller or larger than their right neighbour, the leftmost-smaller (LMS)
substrings are sorted, named and, while names repeat, sorted recursively; then all other
suffixes follow from them, bucket by bucket. Permuted common prefixes (computed only where they
cannot be derived from the place before) tell which windows start with `unit` equal bytes.

Python has no fast loop over suffixes, so a bucket's suffixes are induced together with
array operations; where nearly every name has a bucket of its own (reduced strings of
recursion), ranks are doubled instead.

An anchor with more than CROWD contents is not sent to a single shard: its windows are counted by
Spark by two 64-bit hashes, which gives the same answer.

Text is UTF-8; null and empty texts have no bytes. Matches never cross documents, so a text
under `unit` bytes keeps all. Texts of any length are looked at whole, in chunks that go on where the last segment
ended. Repeated rows are occurrences of their own and each keeps its result row. Null IDs are kept.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from musterline.llm import repeats
from musterline.llm.words import _BYTE, runs_hash

UNIT = 400
GRAM = 100
SHARD = 1 << 20  # bytes aimed at
CROWD = 1500
_BREAK = 255  # never occurs in UTF-8


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one to its right; the last one is larger than the empty suffix."""
    step = np.sign(np.diff(t.astype(np.int64)))
    known = np.append(step, -1) != 0
    at = np.where(known, np.arange(len(t)), len(t))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step, -1)[at] > 0


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order. A bucket holds the suffixes of one first symbol."""
    n, top = len(t), int(t.max()) + 1
    size = np.bincount(t, minlength=top)
    head = np.append(0, np.cumsum(size)[:-1])
    out = np.full(n, -1, np.int64)
    seed_at = np.searchsorted(t[seeds], np.arange(top + 1)) if len(seeds) else np.zeros(top + 1, np.int64)

    def place(before: np.ndarray, put: np.ndarray, ahead: bool) -> None:
        if not len(before):
            return
        order = np.argsort(t[before], kind="stable")
        moved = before[order]
        c = t[moved]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        count = np.diff(np.append(first, len(c)))
        nth = np.arange(len(c)) - np.repeat(first, count)
        out[put[c] + nth if ahead else put[c] - nth] = moved
        put[c[first]] += count if ahead else -count

    # Larger suffixes, from the left. The last suffix is induced by the empty one.
    put = head.copy()
    if not small[n - 1]:
        out[put[t[n - 1]]] = n - 1
        put[t[n - 1]] += 1
    for c in np.flatnonzero(size).tolist():
        done = head[c]
        while done < put[c]:
            now = out[done : put[c]]
            done = put[c]
            before = now[now > 0] - 1
            place(before[~small[before]], put, True)
        before = seeds[seed_at[c] : seed_at[c + 1]] - 1
        place(before, put, True)
    # Smaller suffixes, from the right.
    tail = head + size - 1
    put = tail.copy()
    for c in np.flatnonzero(size)[::-1].tolist():
        done = tail[c]
        while done > put[c]:
            now = out[put[c] + 1 : done + 1][::-1]
            done = put[c]
            before = now[now > 0] - 1
            place(before[small[before]], put, False)
        large = out[head[c] : put[c] + 1][::-1]
        before = large[large > 0] - 1
        place(before[small[before]], put, False)
    return out


def _double(t: np.ndarray) -> np.ndarray:
    """Suffixes in order by doubling ranks."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, step = len(t), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of small numbers in order."""
    n = len(t)
    if n < 3 or int(t.max()) + 1 > max(256, n // 64):
        return _double(t) if n else np.zeros(0, np.int64)
    t = t.astype(np.int64)
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(t, small, lms)
    # Sort LMS substrings: one round of inducing from their first symbols.
    first = _induce(t, small, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    end = np.append(lms[1:] + 1, n)  # a substring ends with the first symbol of the next
    length = np.zeros(n, np.int64)
    length[lms] = end - lms
    name = np.zeros(n, np.int64)
    same = length[order[1:]] == length[order[:-1]]
    same[(order[1:] == lms[-1]) | (order[:-1] == lms[-1])] = False  # the last one ends the text
    live = np.flatnonzero(same)
    offset = 0
    while len(live):  # substrings are short: as many rounds as the longest has symbols
        a, b = order[live] + offset, order[live + 1] + offset
        equal = (t[a] == t[b]) & (small[a] == small[b])
        same[live[~equal]] = False
        live = live[equal]
        offset += 1
        live = live[length[order[live]] > offset]
    name[order] = np.append(0, np.cumsum(~same))
    reduced = name[lms]
    seeds = lms[suffix_array(reduced)] if same.any() else order
    return _induce(t, small, seeds)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in text order: bytes in common with the suffix before it in `order`.

    Where the bytes to the left of both are equal, it is one less than at the place to the left;
    so only the other places are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    derived = (place > 0) & (before > 0)
    derived[1:] &= t[place[1:] - 1] == t[before[1:] - 1]
    start = np.flatnonzero(~derived & (before >= 0))
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(n, np.int64)
    live, offset = start, 0
    while len(live):
        a, b = live + offset, before[live] + offset
        inside = np.minimum(8, n - np.maximum(a, b))
        a, b, keep = a[inside > 0], b[inside > 0], live[inside > 0]
        differ = eight[a] != eight[b]
        differ[np.arange(8) >= inside[inside > 0][:, None]] = True
        differ = np.concatenate([differ, np.ones((len(a), 1), bool)], 1)
        length[keep] += differ.argmax(1)
        live = keep[~differ[:, :8].any(1)]
        offset += 8
    last = np.maximum.accumulate(np.where(derived, 0, place))
    return np.where(derived, length[last] - (place - last), length)


def _payloads(unit: int):
    """The bytes of each segment."""

    def payloads(block: repeats.Block, starts: list[int], counts: list[int]) -> list[bytes]:
        return [block.symbols[a : a + n + unit - 1].tobytes() for a, n in zip(starts, counts, strict=True)]

    return payloads


def _look(unit: int):
    """Which windows of a shard's contents start in another place of the shard too."""

    def look(anchor: np.ndarray, n: np.ndarray, count: np.ndarray, payloads: list[bytes]) -> np.ndarray:
        size = count + unit  # with a break behind each content
        t = np.frombuffer(b"".join(x + bytes([_BREAK]) for x in payloads), np.uint8)
        begin = np.append(0, np.cumsum(size)[:-1])
        order = suffix_array(t)
        prefix = common_prefixes(t, order)
        left = np.repeat(begin + size - 1, size) - np.arange(len(t))  # bytes up to the content's end
        before = np.full(len(t), -1, np.int64)
        before[order[1:]] = order[:-1]
        match = (prefix >= unit) & (left >= unit)
        match[match] &= left[before[match]] >= unit
        hit = match.copy()
        hit[before[match]] = True
        return hit[left >= unit]

    return look


def _split(unit: int):
    """One row for each window of crowded contents, by hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = runs_hash(_BYTE[np.frombuffer(batch.column("payload")[i].as_buffer(), np.uint8)], unit)
                own = batch.take(pa.array(np.full(len(h), i)))
                yield pa.record_batch([own.column("anchor"), own.column("content"), pa.array(np.arange(len(h))), pa.array(h.view(np.int64)), own.column("n")], names=["anchor", "content", "place", "window", "n"])

    return task


def remove_repeats(docs: DataFrame, unit: int = UNIT, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256) of docs (doc_id, text) without strings of `unit` bytes that occur elsewhere."""
    kind = repeats.Kind(unit, min(GRAM, unit), False)
    texts = repeats.texts_of(docs)
    found = repeats.find(texts, kind, _payloads(unit), "suffix")
    runs = repeats.resolve(found.contents, _look(unit), _split(unit), shard, crowd, "suffix")
    return repeats.cut(texts, repeats.ranges(found, runs), kind)
