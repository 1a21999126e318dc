import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from musterline.llm import debruijn, repeats, suffix_array
from tests.llm import odd


def expected(units, k, join):
    """(n, n_removed, n_spans, sha256) by counting every window."""
    met = {}
    for u in units:
        for i in range(len(u) - k + 1):
            met[tuple(u[i : i + k])] = met.get(tuple(u[i : i + k]), 0) + 1
    out = []
    for u in units:
        gone = np.zeros(len(u) + 1, np.int64)
        for i in range(len(u) - k + 1):
            if met[tuple(u[i : i + k])] > 1:
                gone[i : i + k] = 1
        spans = int((np.diff(np.append(0, gone)) == 1).sum())
        kept = [u[i] for i in range(len(u)) if not gone[i]]
        out.append((len(u), int(gone.sum()), spans, hashlib.sha256(join(kept)).hexdigest()))
    return out


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def of_bytes(rows, k):
    return sorted(zip([r[0] for r in rows], expected([list((r[1] or "").encode()) for r in rows], k, bytes), strict=True), key=repr)


def of_words(rows, k):
    return sorted(zip([r[0] for r in rows], expected([words(r[1]) for r in rows], k, b" ".join), strict=True), key=repr)


def got(frame):
    return sorted(((r["doc_id"], (r["n"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in frame.collect()), key=repr)


def short_rows():
    return [r if r[0] != 12 else (12, odd.prose(5, 3000, 900), *r[2:]) for r in odd.rows()]


def passages():
    """Texts that share passages, cut at different places, next to different neighbours."""
    common = odd.prose(50, 90, 4000).split()
    texts = [" ".join(odd.prose(i, 20, 4000).split() + common[i % 20 : 60 + i] + odd.prose(100 + i, 20, 4000).split()) for i in range(25)]
    return [(i, t) for i, t in enumerate(texts)] + [(99, " ".join(common + common))]


def test_words_of_odd_rows(spark):
    docs = odd.clashing(spark.createDataFrame(short_rows(), odd.SCHEMA))
    assert got(debruijn.compact(docs).kept) == of_words(short_rows(), 35)


@pytest.mark.parametrize(("k", "crowd"), [(6, 20_000), (35, 20_000), (35, 2)])
def test_words_of_passages(spark, k, crowd):
    docs = spark.createDataFrame(passages(), "doc_id long, text string").repartition(3)
    assert got(debruijn.compact(docs, k, shard=5000, crowd=crowd).kept) == of_words(passages(), k)


def test_bytes_of_odd_rows(spark):
    docs = odd.clashing(spark.createDataFrame(short_rows(), odd.SCHEMA))
    assert got(suffix_array.remove_repeats(docs)) == of_bytes(short_rows(), 400)


@pytest.mark.parametrize("crowd", [2, 4000])
def test_bytes_of_passages(spark, crowd):
    """The same with and without crowded anchors."""
    docs = spark.createDataFrame(passages(), "doc_id long, text string").repartition(3)
    assert got(suffix_array.remove_repeats(docs, 60, shard=5000, crowd=crowd)) == of_bytes(passages(), 60)


def test_repeated_rows_bring_their_ranges_once(spark):
    rows = [(1, 5, 0, 10), (1, 5, 20, 3), (None, 5, 0, 10)] * 50
    found = repeats.gathered(spark.createDataFrame(rows, "doc_id long, row_key long, start long, count long").repartition(3)).collect()
    assert {r["doc_id"]: sorted(zip(r["starts"], r["counts"], strict=True)) for r in found} == {1: [(0, 10), (20, 3)], None: [(0, 10)]}


def test_empty(spark):
    assert got(debruijn.compact(odd.empty(spark)).kept) == []
    assert got(suffix_array.remove_repeats(odd.empty(spark))) == []


def test_chunks_and_neighbours_do_not_show(monkeypatch):
    from musterline.llm import repeats

    h = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    fields = ("start", "count", "anchor", "content")
    whole = repeats.segments(h, np.array([0, 5000]), 35, 8)
    assert whole.count.sum() == len(h) - 34
    at = np.array([0, 10, 10, 700, 740, 3000, 5000])
    many = repeats.segments(h, at, 35, 8)
    each = [repeats.segments(h[a:b], np.array([0, b - a]), 35, 8) for a, b in zip(at, at[1:], strict=False)]
    for x in fields:
        assert (getattr(many, x) == np.concatenate([getattr(s, x) + (a if x == "start" else 0) for s, a in zip(each, at, strict=False)])).all()
    monkeypatch.setattr(repeats, "_CHUNK", 100)
    parts = repeats.segments(h, np.array([0, 5000]), 35, 8)
    assert all((getattr(whole, x) == getattr(parts, x)).all() for x in fields)


def test_paths_end_where_texts_part(spark):
    a, b, c = (odd.prose(i, 80, 10**6) for i in (1, 2, 3))
    docs = spark.createDataFrame([(1, f"{a} {b}"), (2, f"{a} {b}"), (3, f"{a} {c}"), (4, f"{a} {c}")], "doc_id long, text string")
    graph = debruijn.compact(docs)
    edges = graph.edges
    named = {r["edge"]: r["path"] for r in graph.paths.collect()}
    of = {}
    for r in edges.collect():
        of.setdefault(r["doc_id"], []).append((r["start"], named[r["edge"]]))
    lines = {k: [p for _, p in sorted(set(v))] for k, v in of.items()}
    assert lines[1] == lines[2] and lines[3] == lines[4]
    assert lines[1][0] == lines[3][0] and lines[1][-1] != lines[3][-1]
    assert len(set(lines[1])) < len(lines[1])  # several compact edges on one path
    # What the query removes comes from the paths: a span for each of their occurrences, fewer than edges.
    found = sorted(map(tuple, debruijn.spans(edges, graph.paths).select("doc_id", "start", "count").collect()))
    assert len(found) == sum(len(set(x)) for x in lines.values()) < edges.count()
    covered = {k: {i for d, s, n in found if d == k for i in range(s, s + n)} for k in (1, 2, 3, 4)}
    assert covered == {k: {i for r in edges.collect() if r["doc_id"] == k for i in range(r["start"], r["start"] + r["count"])} for k in (1, 2, 3, 4)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.integers(1, 4))
def test_suffix_array(symbols, times):
    t = np.array(symbols * times, np.uint8)
    raw = t.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert suffix_array.suffix_array(t).tolist() == order
    prefix = suffix_array.common_prefixes(t, np.array(order))
    for i in range(1, len(order)):
        a, b = raw[order[i] :], raw[order[i - 1] :]
        assert prefix[order[i]] == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
