"""Benchmark decontamination: size-partitioned MinHash containment search, then an exact check.

A short item inside a long document has next to no Jaccard similarity with the whole of it. So
items are partitioned by size: those of up to L = 2, 4, 8, ... shingles search windows of
2L shingles that begin every L. An item copied in one run lies within one window, whose size
bounds the similarity from below. Window and item get a one-permutation MinHash signature
of 8L bins (256 at least); a window that agrees with an item in any bin makes the
document a candidate. Candidates are verified by exact containment: distinct shingles of the
item found anywhere in the document, divided by those of the item.

Two bit tables of fixed size (all item shingles; all item signatures) let a task pass over
text that holds nothing of any item; a false hit only costs a lookup. So what is
shuffled follows the matches, and nothing that grows is broadcast.

An item of n < k words is one shingle of n words, and looked for among the n-word shingles of each
document. Items or texts that are null or without words match nothing, and an empty table on either side gives no
rows. Texts are searched whole, however long. Repeated rows, and several documents or items that match
equally well, each get their own result rows. Null IDs are kept. Other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.llm.bits import bit_table, member
from musterline.llm.tables import written
from musterline.llm.words import document_words, mixed, runs_hash, shingle_set


def _span(n: int) -> int:
    """The size class of an item of n shingles: the least power of two, n at least."""
    return 1 << max(n - 1, 0).bit_length()


def signature(shingles: np.ndarray, span: int) -> np.ndarray:
    """The keys of the filled bins: the least shingle of each, marked with its bin and class."""
    bins = np.uint64(max(256, 8 * span))
    h = np.unique(mixed(shingles))
    own = h % bins
    _, first = np.unique(own, return_index=True)
    return mixed(h[first] ^ np.uint64(span))


def _items(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, sets, spans, keys = [], [], [], [], []
            for row, _, _, _, h in document_words(batch.column("text"), fold=True):
                n = min(len(h), k)
                s = shingle_set(h, k) if n in (0, k) else runs_hash(h, n, n)
                if len(s):
                    rows.append(row)
                    lengths.append(n)
                    sets.append(s.view(np.int64))
                    spans.append(_span(len(s)))
                    keys.append(signature(s, spans[-1]).view(np.int64))
            kept = batch.take(pa.array(rows, pa.int64()))
            longs = pa.list_(pa.int64())
            yield pa.record_batch([kept.column("item_id").cast(pa.int64()), pa.array(lengths, pa.int32()), pa.array(spans, pa.int64()), pa.array(sets, longs), pa.array(keys, longs)], names=["item_id", "length", "span", "shingles", "keys"])

    return task


def search(sequence: np.ndarray, hit: np.ndarray, spans: list[int], keys: np.ndarray) -> np.ndarray:
    """The signature keys of a document's windows that some item may have.

    Windows without a hit, a shingle that some item may have, agree with no item in any bin.
    """
    found, place = [np.zeros(0, np.uint64)], np.flatnonzero(hit)
    for span in spans:
        last = max(-(-len(sequence) // span) - 2, 0)
        windows = np.unique(np.minimum(np.append(place // span, np.maximum(place // span - 1, 0)), last))
        for at in (windows * span).tolist():
            own = signature(sequence[at : at + 2 * span], span)
            found.append(own[member(keys, own)])
    return np.unique(np.concatenate(found))


def _candidates(k: int, spans: list[int], short: list[int], tables):
    """short: the lengths of items of fewer than k words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = tables.value
        for batch in batches:
            rows, hits, keys = [], [], []
            for row, _, _, _, h in document_words(batch.column("text"), fold=True):
                sequence = runs_hash(h, k)
                hit = member(have["shingles"], sequence)
                found = [sequence[hit]]
                own = [search(sequence, hit, spans, have["keys"])] if hit.any() else []
                for n in short:
                    runs = np.unique(runs_hash(h, n, n))
                    runs = runs[member(have["shingles"], runs)]
                    key = mixed(mixed(runs) ^ np.uint64(1))  # the signature of each alone
                    found.append(runs)
                    own.append(key[member(have["keys"], key)])
                own = np.unique(np.concatenate(own)) if own else []
                if len(own):
                    rows.append(row)
                    hits.append(np.unique(np.concatenate(found)).view(np.int64))
                    keys.append(own.view(np.int64))
            kept = batch.take(pa.array(rows, pa.int64()))
            longs = pa.list_(pa.int64())
            yield pa.record_batch([kept.column("doc_id").cast(pa.int64()), kept.column("row_key"), pa.array(hits, longs), pa.array(keys, longs)], names=["doc_id", "row_key", "hits", "keys"])

    return task


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, row_key, item_id, n_shingles, n_found): items of which a document holds `percent` of the shingles.

    docs has (doc_id, text), items (item_id, text). row_key is xxhash64(text).
    """
    spark = docs.sparkSession
    items = written(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_items(k), "item_id long, length int, span long, shingles array<long>, keys array<long>").withColumn("item", F.monotonically_increasing_id()), "items")
    kinds = items.select("length", "span").distinct().collect()  # spans are powers of two: 63 at most
    spans, short = sorted({r["span"] for r in kinds if r["length"] == k}), sorted({r["length"] for r in kinds if r["length"] < k})
    tables = spark.sparkContext.broadcast({name: bit_table(items.select(F.explode(name))) for name in ("shingles", "keys")})
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row_key"))
    found = texts.mapInArrow(_candidates(k, spans, short, tables), "doc_id long, row_key long, hits array<long>, keys array<long>")
    found = written(found.withColumn("doc", F.monotonically_increasing_id()), "candidates")

    pairs = found.select("doc", F.explode("keys").alias("key")).join(items.select("item", F.explode("keys").alias("key")), "key").select("doc", "item").distinct()
    held = found.select("doc", F.explode("hits").alias("shingle"))
    wanted = pairs.join(items.select("item", F.explode("shingles").alias("shingle")), "item")
    shared = wanted.join(held, ["doc", "shingle"]).groupBy("doc", "item").agg(F.count("*").alias("n_found"))
    sizes = items.select("item", "item_id", F.size("shingles").cast("long").alias("n_shingles"))
    kept = shared.join(sizes, "item").where(f"100 * n_found >= {percent} * n_shingles")
    return kept.join(found.select("doc", "doc_id", "row_key"), "doc").select("doc_id", "row_key", "item_id", "n_shingles", "n_found")
