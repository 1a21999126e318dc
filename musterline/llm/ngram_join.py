"""Near duplicates by n-gram Jaccard similarity, with adaptive multi-match prefixes.

Shingles have one order for all documents: estimated document frequency, rare first, then
hash. Two sets that are similar enough share at least one of the first |x| - ceil(t|x|) + 1
shingles of each, and at least l of the first |x| - ceil(t|x|) + l. Each document picks its l
by the candidates that its prefix is estimated to bring; two documents are verified when
their prefixes share at least the smaller of their two l.

The frequency estimate is a table of CELLS counters over all documents: its size is fixed,
whatever the corpus. It only steers order and l; the result does not depend on it.

Equal sets are one class and travel once per task. Candidates are verified in rounds: first each
document with its hub, the likeliest original in the lists of documents that share a shingle; then,
a few times, each component with its best neighbour in these lists; then the best candidate
between any two components; then all candidates between what is still apart. So a group of copies
never becomes all its pairs, and no link is lost that would change a component. Before the last two
rounds, parity bitmaps of the sets sieve the candidates: a bit that differs is a shingle that only one of
the two has, so the bound on the overlap is sure, and only pairs that may link bring their sets. The distance
to the hub is exact and Jaccard distances obey the triangle inequality: two documents whose distances to one
hub differ by more than the bound cannot link, and are never paired. Two documents of one hub of many that have too
little of it to link by that alone must share a shingle that it lacks: they meet in lists of such shingles, by
prefixes of these, and not in the lists of what all have from the hub.

Null and empty texts have no shingles and link with nothing; an empty table gives no rows. Very long texts
are shingled whole, and their sets are verified in batches of few rows. Repeated rows keep one output
row each; ties in frequency go by hash, ties in candidates by class. A null ID is kept; it never names a
component unless all its members are null. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from musterline.llm.bits import bit_table, member, room
from musterline.llm.components import components
from musterline.llm.tables import discard, in_batches_of, release, written
from musterline.llm.words import document_words, mixed, shingle_set, whole_hash

CELLS = 1 << 22
_SLICES = 64
_MOST = 8  # longest extension l; longer prefixes cost more than they save
_NEAR_ROUNDS = 1
SHARE = 500  # pairs that one copy of a hub's set serves
CROWD = 32  # documents of one hub from which they meet by what it lacks; with fewer, lists are short anyway


@dataclass(frozen=True)
class Similarity:
    """Link when 100 * |x and y| >= percent * |x or y|, over shingles of k words."""

    k: int = 5
    percent: int = 75

    def least(self, n: np.ndarray) -> np.ndarray:
        """Shingles that a set of n must share with any set it links to."""
        return -(-self.percent * n // 100)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(42)).astype(np.int64)


def _class(tokens: np.ndarray) -> int:
    """One 63-bit name for a set."""
    return whole_hash(tokens, 11) >> 1


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for row, _, _, _, h in document_words(batch.column("text"), fold=True):
            yield batch, row, shingle_set(h, k)


def parities(tokens: np.ndarray) -> bytes:
    """The size of a set, and for each of 2 to 4 cells a shingle whether an odd number of shingles falls into it."""
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mixed(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.int64(len(tokens)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_common(x: bytes, y: bytes) -> tuple[int, int]:
    """The most that two sets can have in common by their parities, and the sum of their sizes."""
    total = int(np.frombuffer(x, np.int64, 1)[0] + np.frombuffer(y, np.int64, 1)[0])
    x, y = np.frombuffer(x, np.uint64, offset=8), np.frombuffer(y, np.uint64, offset=8)
    while len(x) != len(y):  # half as many cells: the two halves of the longer one
        x, y = sorted((x, y), key=len)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (total - int(np.bitwise_count(x ^ y).sum())) // 2, total


_SCAN = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("parities", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])


def _scan(like: Similarity):
    """A row for each document, with parities once for each class, and this task's share of the frequency table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(CELLS, np.uint32), set()
        for batch in batches:
            names, sizes, odd = [], [], []
            for _, _, tokens in _sets([batch], like.k):
                name = _class(tokens) if len(tokens) else None
                fresh = name is not None and name not in seen
                if fresh:
                    seen.add(name)
                    np.add.at(cells, _cells(tokens), 1)
                odd.append(parities(tokens) if fresh else None)
                names.append(name)
                sizes.append(len(tokens))
            m = len(names)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=_SCAN)
        if seen:
            m = _SLICES
            yield pa.record_batch([*[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.binary()), pa.array(range(m), pa.int32()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in np.split(cells, m)], pa.binary())], schema=_SCAN)

    return task


def _add_up(slice_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS // _SLICES, np.uint32)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint16)
    yield pa.record_batch([pa.array([slice_[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def frequency_table(scan: DataFrame) -> np.ndarray:
    """Documents per cell beyond what a cell holds by chance, as a power of two (0 for none): always CELLS bytes."""
    rows = scan.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_add_up, "slice int, counts binary").collect()
    cells = np.zeros(CELLS, np.int64)
    for r in rows:
        cells[r["slice"] * (CELLS // _SLICES) :][: CELLS // _SLICES] = np.frombuffer(r["counts"], np.uint32)
    mean = cells.mean()
    return np.frexp(np.maximum(cells - np.int64(mean + 4 * mean**0.5 + 1), 0).astype(np.float64))[1].astype(np.uint8)


def adaptive_prefix(tokens: np.ndarray, frequent: np.ndarray, like: Similarity) -> tuple[np.ndarray, int]:
    """The prefix of a set and its l: the cheapest of the prefixes by estimated candidates to count and to verify."""
    n = len(tokens)
    level = frequent[_cells(tokens)]
    order = np.lexsort((mixed(tokens), level))
    least = int(like.least(np.int64(n)))
    first = n - least + 1
    most = min(_MOST, least)
    meets = np.cumsum(np.exp2(level[order[: first + most - 1]].astype(np.float64)) - 1)[first - 1 :]
    l = np.arange(1, most + 1)
    cost = (meets + first + l) + meets / l * (n / 16)
    best = int(np.argmin(cost)) + 1
    return tokens[order[: first + best - 1]], best


_POSTING = pa.schema([("token", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("l", pa.int16()), ("place", pa.int32())])


def _postings(like: Similarity, frequent):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            count = [len(x[0]) for x in held]
            return pa.record_batch(
                [
                    pa.array(np.concatenate([x[0] for x in held]).view(np.int64)),
                    pa.array(np.repeat(np.array([x[1] for x in held], np.int64), count)),
                    pa.array(np.repeat(np.array([x[2] for x in held], np.int32), count)),
                    pa.array(np.repeat(np.array([x[3] for x in held], np.int16), count)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in count])),
                ],
                schema=_POSTING,
            )

        for _, _, tokens in _sets(batches, like.k):
            if not len(tokens) or (name := _class(tokens)) in seen:
                continue
            seen.add(name)
            prefix, l = adaptive_prefix(tokens, frequent.value, like)
            held.append((prefix, name, len(tokens), l))
            size += len(prefix)
            if size >= 100_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return task


_PACKED = pa.schema([("class", pa.int64()), ("tokens", pa.binary())])


def _packed(like: Similarity, wanted):
    """Class and sorted set of the texts whose row key may be wanted, each class once a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            kept = batch.filter(pa.array(member(wanted.value, batch.column("row_key").to_numpy())))
            names, sets, size = [], [], 0
            for _, _, tokens in _sets([kept], like.k):
                if not len(tokens) or (name := _class(tokens)) in seen:
                    continue
                seen.add(name)
                names.append(name)
                sets.append(tokens.tobytes())
                size += len(sets[-1])
                if size >= 4 << 20:
                    yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], schema=_PACKED)
                    names, sets, size = [], [], 0
            if names:
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], schema=_PACKED)

    return task


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the two sets of each pair have in common, and in all."""
    for batch in batches:
        common, total = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            common.append(both)
            total.append(len(x) + len(y) - both)
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])


_COMPARED = "a long, b long, common long, total long, n_a long, n_b long, own_a array<long>, own_b array<long>"


def own_prefix(own: np.ndarray, n: int, frequent: np.ndarray, like: Similarity) -> np.ndarray:
    """Of what a set of n has and its hub lacks, the prefix that meets any set it links to that shares enough of it."""
    level = frequent[_cells(own)]
    order = np.lexsort((mixed(own), level))
    least = max(1, int(like.least(np.int64(n))) - (n - len(own)))
    return own[order[: max(0, len(own) - least + 1)]]


def _compared(like: Similarity, frequent):
    """Like _overlaps; for pairs of a crowded hub also both sizes and prefixes of what only one has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, hub, crowded, x, y in zip(*(batch.column(c) for c in ("a", "b", "hub", "crowded", "x", "y")), strict=True):
                a, b, x, y = a.as_py(), b.as_py(), np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if hub.as_py() != a:
                    x, y = y, x
                both = len(np.intersect1d(x, y, assume_unique=True))
                own = [own_prefix(np.setdiff1d(u, v, assume_unique=True), len(u), frequent.value, like).view(np.int64) for u, v in ((x, y), (y, x))] if crowded.as_py() else [None, None]
                rows.append((a, b, both, len(x) + len(y) - both, len(x), len(y), *own))
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["a", "b", "common", "total", "n_a", "n_b", "own_a", "own_b"])

    return task


def _likely(like: Similarity):
    """The pairs that may have enough in common."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = [most_common(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            kept = pa.array([(100 + like.percent) * common >= like.percent * total for common, total in bounds], pa.bool_())
            yield batch.select(["a", "b"]).filter(kept)

    return task


def _verify(pairs: DataFrame, texts: DataFrame, chosen: DataFrame, like: Similarity, task=_overlaps, columns: str = "a long, b long, common long, total long") -> DataFrame:
    """The candidate pairs with what their sets have in common; the set of a class comes from the text of its chosen row."""
    spark = pairs.sparkSession
    ends = _ends(pairs)
    keys = written(chosen.join(ends, "class", "left_semi").select("row_key"), "ngram-keys")
    wanted = spark.sparkContext.broadcast(bit_table(keys, room(keys.count())))
    sets = texts.select("text", "row_key").mapInArrow(_packed(like, wanted), "class long, tokens binary").groupBy("class").agg(F.first("tokens").alias("tokens"))
    found = _meet(pairs, ends, sets, task, columns, "ngram-verified")
    for table in (ends, keys):
        discard(table)
    wanted.unpersist()
    return found


def _sieve(pairs: DataFrame, scan: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) that may link by their parities."""
    ends = _ends(pairs)
    odd = scan.where("parities is not null").select("class", "parities").join(ends, "class", "left_semi")
    found = _meet(pairs, ends, odd.groupBy("class").agg(F.first("parities").alias("tokens")), _likely(like), "a long, b long", "ngram-likely")
    discard(ends)
    return found


def _ends(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("pairs")), "ngram-ends")


def _meet(pairs: DataFrame, ends: DataFrame, sets: DataFrame, task, columns: str, name: str) -> DataFrame:
    """What `task` makes of the pairs and what their two classes have in sets (class, tokens): x of hub, y of the other.

    A set is shuffled once by class and once for its pair. Of a pair, the class that is in more pairs comes to
    the other one: as one copy for every SHARE pairs, so a hub of any number of documents is many small keys.
    """
    spark = pairs.sparkSession
    one, two = ends.selectExpr("class as a", "pairs as of_a"), ends.selectExpr("class as b", "pairs as of_b")
    turned = pairs.join(one, "a").join(two, "b").select(*pairs.columns, F.expr("if(of_a >= of_b, a, b)").alias("hub"), F.expr("if(of_a >= of_b, b, a)").alias("leaf"), F.greatest("of_a", "of_b").alias("met"))
    turned = written(turned.withColumn("share", F.expr(f"pmod(xxhash64(leaf), 1 + met div {SHARE})")).drop("met"), "ngram-turned")
    copies = written(turned.select("hub", "share").distinct(), "ngram-copies")
    hubs = copies.join(sets.select(F.col("class").alias("hub"), F.col("tokens").alias("x")), "hub")
    leaves = turned.join(sets.select(F.col("class").alias("leaf"), F.col("tokens").alias("y")), "leaf")
    met = leaves.join(hubs, ["hub", "share"]).select(*pairs.columns, "hub", "x", "y")
    with in_batches_of(spark, 64):
        found = written(met.mapInArrow(task, columns), name)
    for table in (turned, copies):
        discard(table)
    del sets, hubs, leaves, met
    release(spark)
    return found


def _links(verified: DataFrame, like: Similarity) -> DataFrame:
    return verified.where(f"100 * common >= {like.percent} * total").select("a", "b", "common", "total")


def _size_fits(n: Column, m: Column, like: Similarity) -> Column:
    return 100 * F.least(n, m) >= like.percent * F.greatest(n, m)


def _in_reach(x: str, y: str, like: Similarity) -> Column:
    """Whether two sets that meet at a shingle can have enough in common: before, at and behind it."""
    most = f"least({x}rank, {y}rank) + least({x}n - {x}place, {y}n - {y}place) - 1"
    return F.expr(f"{most} >= {like.percent} * ({x}n + {y}n) / {100 + like.percent}")


_SIZES = "max(least(one.n, two.n)) as smaller", "max(one.n + two.n) as both"


def _meetings(lists: DataFrame, keys: list[str], fits: Column) -> GroupedData:
    """Pairs (a, b) of classes one and two that meet in lists of `keys` under different labels.

    The most frequent label of a list (usually a large component) is not paired with itself, so a list costs
    its rows times those of other labels. The smaller set must have the shingle in its `short` prefix.
    """
    by = ", ".join(keys)
    lists = lists.withColumn("varied", F.expr(f"max(label) over (partition by {by}) <> min(label) over (partition by {by})")).where("varied")
    lists = lists.withColumn("times", F.expr(f"count(*) over (partition by {by}, label)"))
    lists = lists.withColumn("main", F.expr(f"(max(struct(times, label)) over (partition by {by})).label = label")).drop("varied", "times")
    same = " and ".join(f"one.{key} = two.{key}" for key in keys)
    smaller = "(one.n < two.n or (one.n = two.n and one.class < two.class))"
    apart = F.expr(f"{same} and one.label <> two.label and (two.main or {smaller}) and if({smaller}, one.short, two.short)")
    met = lists.where("not main").alias("one").join(lists.alias("two"), apart & fits)
    return met.groupBy(F.expr("least(one.class, two.class)").alias("a"), F.expr("greatest(one.class, two.class)").alias("b"))


@dataclass(frozen=True)
class Joined:
    """documents: doc_id, n_shingles, component_id. links: verified pairs of classes (a, b, common, total).

    rows: doc_id, row_key (xxhash64 of the text), n, class, and top, the class that stands for the component.
    """

    documents: DataFrame
    links: DataFrame
    rows: DataFrame


def ngram_join(docs: DataFrame, like: Similarity = Similarity()) -> Joined:
    """Components of documents (doc_id, text) whose shingle sets are similar enough."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row_key"))
    scan = written(texts.mapInArrow(_scan(like), "doc_id long, row_key long, class long, n long, parities binary, slice int, counts binary"), "ngram-scan")
    rows = scan.where("slice is null").select("doc_id", "row_key", "class", "n")
    frequent = spark.sparkContext.broadcast(frequency_table(scan))

    # Lists of the classes that share a prefix shingle; lists of one class go.
    by_token, in_list = "partition by token", "partition by token order by n, class"
    shared = (
        texts.select("text")
        .mapInArrow(_postings(like, frequent), "token long, class long, n int, l short, place int")
        .withColumns({"previous": F.expr(f"lag(class) over ({in_list})"), "varied": F.expr(f"max(class) over ({by_token}) <> min(class) over ({by_token})")})
        .where("varied and (previous is null or previous <> class)")
        .select("token", "class", "n", "l", "place")
    )
    # A shingle in common with a similar set has at most `rank` others in common before it (what
    # no other prefix has is not in common) and what follows it behind: too little, and it goes.
    shared = written(
        shared.withColumns({"rank": F.expr("row_number() over (partition by class order by place)"), "degree": F.expr("count(*) over (partition by class)")})
        .where(f"100 * (rank + n - place - 1) >= {like.percent} * n"),
        "ngram-shared",
    )
    release(spark)

    # The row whose text stands for a class.
    chosen = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "row_key")).alias("r")).select("class", "r.doc_id", "r.row_key")

    # Neighbours: each member with the one before it and with the head of its lists, the one that shares
    # most of itself: an original rather than its copies.
    ranked = shared.withColumns({
        "previous": F.expr(f"lag(struct(class, n, place, rank, false as head)) over ({in_list})"),
        "first": F.expr(f"first(struct(class, n, place, rank, true as head)) over ({by_token} order by degree / n desc, n, class)"),
    })
    near = ranked.select("class", "n", "place", "rank", F.explode(F.array("previous", "first")).alias("other")).where("other is not null and other.class <> class")
    near = near.where(_size_fits(F.col("n"), F.col("other.n"), like) & _in_reach("", "other.", like))
    near = near.groupBy("class", F.col("other.class").alias("other")).agg(F.count("*").alias("meets"), F.max("other.head").alias("head"), F.min(F.least("n", "other.n")).alias("n"))
    near = written(near.where("meets >= 1 + n / 50").selectExpr("class", "other", "meets / n as share", "head"), "ngram-near")
    release(spark)

    # The hub of each class, and the exact distance to it.
    hubs = written(near.where("head").groupBy("class").agg(F.max_by("other", F.struct("share", "other")).alias("hub")), "ngram-hubs")
    crowds = hubs.groupBy("hub").agg(F.count("*").alias("leaves")).where(f"leaves >= {CROWD}").select("hub", F.lit(True).alias("crowded"))
    hubs = written(hubs.join(crowds, "hub", "left").select("class", "hub", F.expr("crowded is not null").alias("crowded")), "ngram-crowds")
    tried = written(hubs.groupBy(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).agg(F.max("crowded").alias("crowded")), "ngram-tried")
    verified = [_verify(tried, texts, chosen, like, _compared(like, frequent), _COMPARED)]
    tried = tried.select("a", "b")
    hubs = hubs.join(verified[0], (F.least("class", "hub") == F.col("a")) & (F.greatest("class", "hub") == F.col("b")))
    first_is = lambda x, y: F.expr(f"if(crowded, if(class = a, {x}, {y}), null)")
    # Of a crowded hub: what a class has in common with it, its size, and the prefix of what the hub lacks.
    hubs = written(hubs.select("class", "hub", (1 - F.col("common") / F.col("total")).alias("d"), first_is("common", "common").alias("of_hub"), first_is("n_a", "n_b").alias("n"), first_is("own_a", "own_b").alias("own")), "ngram-distances")
    first = _links(verified[0], like)
    groups = components(first.select("a", "b"))

    # Each component with its best neighbour, where that is another component.
    pairs = near.groupBy(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).agg(F.max("share").alias("share"))
    for _ in range(_NEAR_ROUNDS):
        one, two = groups.selectExpr("node as a", "root as ra"), groups.selectExpr("node as b", "root as rb")
        apart = pairs.join(tried, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")
        apart = written(apart.select("a", "b", "share", "ra", "rb"), "ngram-apart")
        best = apart.select("a", "b", "share", F.explode(F.array("ra", "rb")).alias("label")).groupBy("label").agg(F.max(F.struct("share", "a", "b")).alias("p"))
        best = written(best.select("p.a", "p.b").distinct(), "ngram-best")
        if best.isEmpty():
            break
        verified.append(_verify(best, texts, chosen, like))
        tried = written(tried.union(best), "ngram-tried")
        first = first.union(_links(verified[-1], like))
        groups = components(first.select("a", "b"))

    # Candidates: all pairs that meet often enough and are not within one component yet. A set and
    # one of its size or more share so much that a shorter prefix of the smaller one is enough.
    labelled = shared.join(groups, shared["class"] == groups["node"], "left")
    labelled = labelled.select("token", "class", "n", "l", "place", "rank", F.coalesce("root", "class").alias("label")).join(hubs.select("class", "hub", "d", "of_hub"), "class", "left")
    labelled = labelled.withColumn("short", F.expr(f"place < n - ceil(2 * {like.percent} * n / {100 + like.percent}) + l"))
    # Triangle inequality at a common hub; a hub is at distance 0 from itself, and that pair has been tried.
    # Those of a crowded hub that need a shingle it lacks meet below.
    far = f"abs(one.d - two.d) > {1 - like.percent / 100 + 1e-9}"
    needs_own = f"{100 + like.percent} * least(one.of_hub, two.of_hub) < {like.percent} * (one.n + two.n)"
    fits = _size_fits(F.col("one.n"), F.col("two.n"), like)
    met = _meetings(labelled, ["token"], F.expr(f"not coalesce(one.hub = two.hub and ({far} or {needs_own}), false)") & _in_reach("one.", "two.", like) & fits)
    pairs = (
        met.agg(F.count("*").alias("meets"), F.max(F.expr("least(one.l, two.l)")).alias("l"), F.min(F.expr("least(one.n - one.place, two.n - two.place)")).alias("left"), *map(F.expr, _SIZES))
        .where("meets >= l")
        # Behind the last shingle that both prefixes share there must be enough left for the overlap.
        .where(f"{100 + like.percent} * (meets + left - 1) >= {like.percent} * both")
        .select("a", "b", (F.col("meets") / F.col("smaller")).alias("share"))
    )
    own = hubs.where("own is not null").join(groups, F.col("class") == F.col("node"), "left")
    own = own.select("class", "hub", "d", "of_hub", "n", F.coalesce("root", "class").alias("label"), F.posexplode("own").alias("place", "token"))
    own = own.withColumns({"left": F.expr("n - of_hub - place"), "short": F.lit(True)})
    # In common: from the hub what both may have of it, before the shingle, and it and what follows.
    most = "least(one.of_hub, two.of_hub) + least(one.place, two.place) + least(one.left, two.left)"
    met = _meetings(own, ["hub", "token"], F.expr(f"not {far} and {needs_own} and {100 + like.percent} * ({most}) >= {like.percent} * (one.n + two.n)") & fits)
    met = met.agg(F.count("*").alias("meets"), F.max(F.expr("least(one.of_hub, two.of_hub)")).alias("of_hub"), F.min(F.expr("least(one.left, two.left)")).alias("left"), *map(F.expr, _SIZES))
    met = met.where(f"{100 + like.percent} * (of_hub + meets + left - 1) >= {like.percent} * both")
    pairs = pairs.union(met.select("a", "b", (F.col("meets") / F.col("smaller")).alias("share"))).join(tried, ["a", "b"], "left_anti")
    one, two = groups.selectExpr("node as a", "root as ra"), groups.selectExpr("node as b", "root as rb")
    pairs = pairs.join(one, "a", "left").join(two, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    pairs = pairs.select("a", "b", F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high"), "share")
    candidates = written(pairs, "ngram-pairs")
    release(spark)
    pairs = written(candidates.join(_sieve(candidates, scan, like), ["a", "b"], "left_semi"), "ngram-sieved")
    discard(candidates)

    # Round 2: the best pair between any two components. Round 3: the rest, between what is still apart.
    best = written(pairs.groupBy("low", "high").agg(F.max(F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b"), "ngram-best")
    second = _links(_verify(best, texts, chosen, like), like)
    groups = components(first.select("a", "b").union(second.select("a", "b")))
    left, right = groups.selectExpr("node as a", "root as ra"), groups.selectExpr("node as b", "root as rb")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
    rest = written(rest.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), "ngram-rest")
    third = _links(_verify(rest, texts, chosen, like), like)
    links = first.union(second).union(third)

    # Contract the components so far by the links of round 3.
    roots = groups.withColumnsRenamed({"node": "class"})
    over = third.join(roots.withColumnsRenamed({"class": "a", "root": "ra"}), "a", "left").join(roots.withColumnsRenamed({"class": "b", "root": "rb"}), "b", "left")
    over = components(over.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).selectExpr("node as root", "root as top")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    tops = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")).join(over, "root", "left")
    tops = written(tops.select("class", "least", F.coalesce("top", "root").alias("top")), "ngram-tops")
    named = tops.join(tops.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("class", "top", "component_id")
    placed = rows.join(named, "class", "left")
    documents = placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return Joined(documents, links, placed.select("doc_id", "row_key", "n", "class", "top"))
