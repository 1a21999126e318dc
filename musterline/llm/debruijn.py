"""Repeated word spans by de Bruijn graph compaction.

An edge is a window of k words, between its first and its last k - 1 words; only edges that occur
more than once are of interest. Edges are partitioned by their anchors (see repeats.py), and
neighbouring edges of one anchor are kept as one segment. Where an anchor always has the same
content, the segment is a path without branches: whoever passes one of its edges passes
all of them, so it stays one compact edge. The other segments may branch inside: they are
taken apart into single edges, counted by window hash where all contents of an anchor meet.

`paths` joins compact edges further: B follows A where every occurrence of A is directly
followed by B and every occurrence of B directly follows A. A path occurs wherever its first edge does, so
what is removed is the spans of whole paths, by the coordinates of their first edges, merged per text.

Null and empty texts, and texts under k words, have no edges. Repeated rows are occurrences
of their own and each keeps its result row; equal spans of equal rows are one. Null IDs are kept. Very long
texts are cut into chunks that go on where the last segment ended. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.llm import repeats
from musterline.llm.components import components
from musterline.llm.tables import written
from musterline.llm.words import mixed, runs_hash

GRAM = 20
SHARD = 4 << 20  # bytes of window hashes aimed at
CROWD = 20_000


@dataclass(frozen=True)
class Graph:
    """edges: (doc_id, row_key, start, count, edge) each occurrence of a repeated compact edge; paths: see `paths`; kept: result per text."""

    edges: DataFrame
    paths: DataFrame
    kept: DataFrame


def _payloads(k: int):
    """The hashes of all windows of each segment."""

    def payloads(block: repeats.Block, starts: list[int], counts: list[int]) -> list[bytes]:
        h = runs_hash(block.symbols, k)
        return [h[a : a + n].tobytes() for a, n in zip(starts, counts, strict=True)]

    return payloads


def _look(anchor: np.ndarray, n: np.ndarray, count: np.ndarray, payloads: list[bytes]) -> np.ndarray:
    """Which windows occur more than once with the same anchor."""
    key = mixed(np.repeat(anchor.view(np.uint64), count)) ^ np.frombuffer(b"".join(payloads), np.uint64)
    _, inverse = np.unique(key, return_inverse=True)
    return np.bincount(inverse, np.repeat(n, count))[inverse] > 1


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each edge of a segment."""
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            loads = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("payload")]
            size = [len(x) for x in loads]
            row = np.repeat(np.arange(part.num_rows), size)
            own = part.take(pa.array(row))
            place = np.concatenate([np.arange(n) for n in size])
            yield pa.record_batch([own.column("anchor"), own.column("content"), pa.array(place, pa.int64()), pa.array(np.concatenate(loads)), own.column("n")], names=["anchor", "content", "place", "window", "n"])


def compact(docs: DataFrame, k: int = 35, shard: int = SHARD, crowd: int = CROWD) -> Graph:
    """Repeated edges of k words in docs (doc_id, text), and each text without them."""
    kind = repeats.Kind(k, min(GRAM, k), True)
    texts = repeats.texts_of(docs)
    found = repeats.find(texts, kind, _payloads(k), "debruijn")
    runs = repeats.resolve(found.contents, _look, _split, shard, crowd, "debruijn")
    branching = found.mixed.join(runs, ["anchor", "content"])
    branching = branching.select("doc_id", "row_key", (F.col("start") + F.col("from")).alias("start"), F.col("edges").alias("count"), F.xxhash64("anchor", "content", "from").alias("edge"))
    edges = written(found.solid.withColumnRenamed("anchor", "edge").unionByName(branching).distinct(), "debruijn-seats")
    joined = written(paths(edges), "debruijn-paths")
    return Graph(edges, joined, repeats.cut(texts, spans(edges, joined), kind))


def spans(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, count): each occurrence of a path, from its first edge over the windows of all its edges."""
    whole = joined.groupBy("path").agg(F.sum("count").alias("windows"), F.max(F.when(F.col("first"), F.col("edge"))).alias("edge"))
    return edges.drop("count").join(whole.select("edge", "windows"), "edge").select("doc_id", "row_key", "start", F.col("windows").alias("count"))


def paths(edges: DataFrame) -> DataFrame:
    """(edge, count, path, first): compact edges that follow each other without branches share a path; one is its first.

    `edges` has no row twice. A row without a neighbour directly behind or before it ends a path there. A path
    has two ends, as the last edge of a text is followed by nothing.
    """
    seats = edges.select("doc_id", "row_key", "start", (F.col("start") + F.col("count")).alias("end"), "edge")
    one, two = seats.alias("one"), seats.alias("two")
    next_ = one.join(two, F.expr("one.row_key = two.row_key and one.doc_id <=> two.doc_id and one.end = two.start"), "left").select(F.col("one.edge").alias("a"), F.col("two.edge").alias("b"))
    next_ = written(next_.groupBy("a", "b").agg(F.count("*").alias("n")), "debruijn-next")
    whole = written(edges.groupBy("edge").agg(F.count("*").alias("met"), F.min("count").alias("count")), "debruijn-edges")
    # Of a, all occurrences go on to b; of b, all come from a.
    pairs = next_.where("b is not null and a <> b").join(whole.selectExpr("edge as a", "met as met_a"), "a").join(whole.selectExpr("edge as b", "met as met_b"), "b")
    links = written(pairs.where("n = met_a and n = met_b").select("a", "b"), "debruijn-links")
    named = components(links)
    behind = links.select(F.col("b").alias("edge"), F.lit(True).alias("behind"))
    placed = whole.select("edge", "count").join(named, whole["edge"] == named["node"], "left").join(behind, "edge", "left")
    return placed.select("edge", "count", F.coalesce("root", "edge").alias("path"), F.col("behind").isNull().alias("first"))
