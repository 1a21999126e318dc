"""Phrase collocations, counted in weighted acyclic automata.

Three steps, each made of passes that Spark partitions:

1. What can be frequent. Words, pairs and triples of neighbours are counted by 64-bit hash, in one pass and all of
   them, so that its rows follow the words of the corpus whatever the threshold; what was seen `least` times fills bit
   tables. A longer phrase can only be frequent where all its triples are. The tables only leave work out: every count
   used below is taken again, by the words themselves.
2. Counts. Each task sorts the n-grams of its shard that may be frequent and builds count
   transducers from them (`automata.Transducer`), one for each range of prefixes, the first two words.
   Transducers of one range are united and their counts added, sixteen groups of shards first, then all;
   rare n-grams leave the last union. A very frequent first word spans many ranges.
3. Parts. What a cut leaves of a phrase, its first part and its rest, is looked up by composing an automaton of
   the parts asked for in a range with the count transducer of that range. Scores are decimals of 38 digits.

Bounds of the ranges are quantiles of the prefixes of SAMPLE texts' beginnings; they deal out the work and change
no result. A phrase that never occurs outside a longer candidate is dropped: as counts fall with length, the
candidates longer by one word tell. The best of a language are cut to `top` in 64 groups first.

A null language is `und`, a null text has no words. Repeated rows count each. Ties in score go by count, then by the
phrase's bytes. Very long texts are hashed in blocks. No documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterline.llm.automata import Item, Transducer, union
from musterline.llm.bits import bit_table, member, room
from musterline.llm.tables import written
from musterline.llm.words import mixed, runs_hash, text_bytes, word_hashes

SHARD = 1_500_000  # words a task holds before it builds transducers
BLOCK = 1_000_000  # words it hashes at once where it counts keys
KEYS = 4_000_000  # distinct keys it adds up before it sends them
SAMPLE, BEGINNING = 500, 4_000  # texts, and characters of each, that set the bounds of ranges
PER_RANGE = 10_000  # frequent keys a range should have
SCORE = "(1000bd * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
_SALTS = 16
_FOLD = 64  # transducers united at once
_BREAK = np.arange(256, dtype=np.uint8)
_BREAK[list(b".,;:!?\x0b\x0c\r")] = 10


@dataclass(frozen=True)
class Rule:
    """Phrases of 2 to `longest` words seen `least` times or more; the first `top` of each language."""

    longest: int = 5
    least: int = 100
    top: int = 2000


def piece_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as bytes, and start, end and hash (A-Z lower-cased) of each word, and whether it begins a piece."""
    data, at = text_bytes(column)
    data = np.insert(data, at[1:], 10)
    broken = _BREAK[data]
    starts, ends, hashes = word_hashes(broken, fold=True)
    fresh = np.zeros(len(starts) + 1, bool)
    fresh[0] = True
    fresh[np.searchsorted(starts, np.flatnonzero(broken == 10))] = True
    return data, starts, ends, hashes, fresh[:-1]


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest()))


def _word_keys(hashes: np.ndarray, lang: str) -> np.ndarray:
    return mixed(hashes ^ _seed(lang))


def _pair_keys(hashes: np.ndarray, lang: str) -> np.ndarray:
    return mixed(runs_hash(hashes, 2) + _seed(lang))


def _triple_keys(hashes: np.ndarray, lang: str) -> np.ndarray:
    return mixed(runs_hash(hashes, 3) + _seed(lang))


def _likely_pairs(h: np.ndarray, fresh: np.ndarray, words: np.ndarray, frequent: np.ndarray, lang: str) -> np.ndarray:
    """Where a word and the one behind it may be a frequent pair."""
    pairs = np.zeros(len(h), bool)
    pairs[:-1] = words[:-1] & words[1:] & ~fresh[1:]
    at = np.flatnonzero(pairs)
    if len(at):
        pairs[at] = member(frequent, _pair_keys(h, lang)[at])
    return pairs


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column("lang")
    for lang in langs.unique().to_pylist():
        yield lang, batch.filter(pa.compute.equal(langs, lang)).column("text")


_COUNTED = pa.schema([("size", pa.int8()), ("key", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])
_COUNTED_COLUMNS = "size byte, key long, lang string, n long"


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several counts, with their sums."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


class _Tally:
    """Counts of keys of one size, added up in the task before they are sent."""

    def __init__(self, size: int):
        self.size, self.parts, self.held = size, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.held += len(self.parts[-1][0])
        if self.held >= KEYS:
            self.parts = [_added(self.parts)]
            self.held = len(self.parts[0][0])
            if self.held >= KEYS // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        found, n = _added(self.parts)
        self.parts, self.held = [], 0
        for i in range(0, len(found), 500_000):
            part = slice(i, i + 500_000)
            m = len(found[part])
            yield pa.record_batch([pa.array(np.full(m, self.size, np.int8)), pa.array(found[part].view(np.int64)), pa.nulls(m, pa.string()), pa.array(n[part])], schema=_COUNTED)


def _tallied(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], keys_of: Callable) -> Iterator[pa.RecordBatch]:
    """Counts of the keys that `keys_of` (language, word hashes, whether they begin a piece) gives for each size; size 0 counts words."""
    held: dict[str, list] = defaultdict(list)
    tallies, words, size = [_Tally(k) for k in sizes], defaultdict(int), 0

    def settle() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            h, fresh = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            words[lang] += len(h)
            for tally, keys in zip(tallies, keys_of(lang, h, fresh), strict=True):
                yield from tally.add(keys)

    for batch in batches:
        for lang, column in _by_language(batch):
            _, _, _, h, fresh = piece_words(column)
            held[lang].append((h, fresh))
            size += len(h)
        if size >= BLOCK:
            yield from settle()
            size = 0
    yield from settle()
    for tally in tallies:
        yield from tally.out()
    if words:
        m = len(words)
        yield pa.record_batch([pa.array(np.zeros(m, np.int8)), pa.nulls(m, pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], schema=_COUNTED)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size 0: words of a language; 1: a word's key and count; 2: a pair's; 3: a triple's."""
    return _tallied(batches, (1, 2, 3), lambda lang, h, fresh: (_word_keys(h, lang), _pair_keys(h, lang)[~fresh[1:]], _triple_keys(h, lang)[~(fresh[1:-1] | fresh[2:])]))


def grams(h: np.ndarray, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, names: dict[int, str], longest: int) -> list[Item]:
    """Sorted n-grams with counts. words, pairs, triples: which may count, alone and with the words behind."""
    own = np.unique(h[words])
    spelt = [names[x] for x in own.tolist()]
    order = sorted(range(len(own)), key=spelt.__getitem__)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    spelt = [spelt[i] for i in order]
    ids = np.full(len(h), -1, np.int32)
    ids[words] = rank[np.searchsorted(own, h[words])]
    at = np.flatnonzero(words)
    code, known = ids, [()]
    found: list[Item] = []
    for k in range(1, longest + 1):
        if k > 1:
            at = at[at + k - 1 < len(h)]
            at = at[pairs[at] if k == 2 else triples[at + k - 3]]
        behind = code[at].astype(np.int64) * len(own) + ids[at + k - 1] if k > 1 else ids[at]
        values, place, n = np.unique(behind, return_inverse=True, return_counts=True)
        known = [(*known[a], spelt[b]) for a, b in zip((values // len(own)).tolist(), (values % len(own)).tolist())] if k > 1 else [(spelt[b],) for b in values.tolist()]
        found.extend(zip(known, n.tolist()))
        code = np.full(len(h), -1, np.int32)
        code[at] = place
    found.sort()
    return found


_PLACE = ("lang", "range")
_SHARD_ROWS = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("labels", pa.list_(pa.string())), ("packed", pa.binary())])
_SHARD_COLUMNS = "lang string, range int, labels array<string>, packed binary"


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SHARD_ROWS, strict=True)], schema=_SHARD_ROWS)


def _range(labels: tuple[str, ...] | list[str], bounds: list[str]) -> int:
    return bisect_right(bounds, " ".join(labels[:2]))


def _shards(rule: Rule, frequent, frequent_triples, bounds):
    """Transducers of each shard, by language and range of prefixes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, dict[int, str]] = defaultdict(dict)
        held: dict[str, list] = defaultdict(list)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                h, fresh, words = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
                pairs = _likely_pairs(h, fresh, words, frequent.value, lang)
                triples = np.zeros(len(h), bool)
                triples[:-1] = pairs[:-1] & pairs[1:]
                at = np.flatnonzero(triples)
                if len(at):
                    triples[at] = member(frequent_triples.value, _triple_keys(h, lang)[at])
                ranges: dict[int, list[Item]] = defaultdict(list)
                for item in grams(h, words, pairs, triples, names.pop(lang, {}), rule.longest):
                    ranges[_range(item[0], bounds.value)].append(item)
                rows, full = [], 0
                for place, items in ranges.items():
                    rows.append((lang, place, *Transducer.build(items).pack()))
                    full += len(rows[-1][3])
                    if full >= 4 << 20:
                        yield _shard_rows(rows)
                        rows, full = [], 0
                if rows:
                    yield _shard_rows(rows)

        for batch in batches:
            for lang, column in _by_language(batch):
                data, s, e, h, fresh = piece_words(column)
                words = member(frequent.value, _word_keys(h, lang)) if len(h) else np.zeros(0, bool)
                at = np.flatnonzero(words)
                own, first = np.unique(h[at], return_index=True)
                for x, i in zip(own.tolist(), at[first].tolist()):
                    if x not in names[lang]:
                        names[lang][x] = data[s[i] : e[i]].tobytes().lower().decode()
                held[lang].append((h, fresh, words))
                size += len(h)
            if size >= SHARD:
                yield from out()
                size = 0
        yield from out()

    return task


def _unite(least: int) -> Callable:
    """Neighbouring rows of one language and range become one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, same, rows, full = None, [], [], 0

        def united() -> tuple | None:
            if len(same) == 1 and isinstance(same[0], tuple) and not least:
                return (*key, *same[0])
            whole = union((Transducer.unpack(*x) if isinstance(x, tuple) else x for x in same), least)
            return (*key, *whole.pack()) if whole.arcs[whole.start] else None

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _SHARD_ROWS.names), strict=True):
                if row[:2] != key:
                    if same and (row_out := united()):
                        rows.append(row_out)
                        full += len(row_out[3])
                    key, same = row[:2], []
                same.append(row[2:])
                if len(same) == _FOLD:
                    same = [union(Transducer.unpack(*x) if isinstance(x, tuple) else x for x in same)]
                if full >= 4 << 20:
                    yield _shard_rows(rows)
                    rows, full = [], 0
        if same and (row_out := united()):
            rows.append(row_out)
        if rows:
            yield _shard_rows(rows)

    return task


_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])


def _phrases(lang: str, items: Iterator[Item]) -> pa.RecordBatch:
    items = list(items)
    return pa.record_batch([pa.array([lang] * len(items), pa.string()), pa.array([" ".join(x) for x, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], schema=_PHRASES)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sequences of two words or more."""
    for batch in batches:
        for lang, labels, packed in zip(*(batch.column(c).to_pylist() for c in ("lang", "labels", "packed")), strict=True):
            yield _phrases(lang, (x for x in Transducer.unpack(labels, packed).items() if len(x[0]) > 1))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, labels, packed, asked in zip(*(batch.column(c).to_pylist() for c in ("lang", "labels", "packed", "asked")), strict=True):
            parts = Transducer.build((x, 0) for x in sorted(tuple(p.split(" ")) for p in asked))
            yield _phrases(lang, Transducer.unpack(labels, packed).compose(parts))


def _placed(bounds):
    """Phrases asked for, with the range of their prefix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [_range(x.split(" ", 2), bounds.value) for x in batch.column("phrase").to_pylist()]
            yield pa.record_batch([batch.column("lang"), pa.array(places, pa.int32()), batch.column("phrase")], names=["lang", "range", "phrase"])

    return task


@dataclass(frozen=True)
class Counts:
    """totals: lang, n. transducers: lang, range, labels, packed. bounds: a broadcast of the first prefix of each range but the first."""

    totals: DataFrame
    transducers: DataFrame
    bounds: object


def _bounds(texts: DataFrame, ranges: int) -> list[str]:
    """Quantiles of the two-word prefixes in the beginnings of some texts: SAMPLE rows at most, however many there are."""
    share = min(1.0, 2 * SAMPLE / max(1, texts.count()))
    drawn = texts.where("text <> ''").sample(share, seed=7).select(F.substring("text", 1, BEGINNING).alias("text")).limit(SAMPLE).collect()
    prefixes = []
    for r in drawn:
        data, s, e, _, fresh = piece_words(pa.array([r["text"]]))
        words = [data[a:b].tobytes().lower().decode() for a, b in zip(s, e)]
        prefixes += [x if f else f"{x} {y}" for x, y, f in zip(words, words[1:], fresh[1:])]
    prefixes.sort()
    return sorted({prefixes[len(prefixes) * i // ranges] for i in range(1, ranges)}) if prefixes else []


def count(docs: DataFrame, rule: Rule = Rule()) -> Counts:
    """Count transducers of all n-grams of documents (text, lang) seen `rule.least` times or more."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))

    def table(keys: DataFrame, n: int):
        return spark.sparkContext.broadcast(bit_table(keys, room(n)))

    counted = texts.mapInArrow(_count, _COUNTED_COLUMNS).repartition("key")  # tasks have summed their keys: no use in doing so again before the shuffle
    seen = written(counted.groupBy("size", "key", "lang").agg(F.sum("n").alias("n")).where(f"size = 0 or n >= {rule.least}"), "colloc-seen")
    totals = written(seen.where("size = 0").select("lang", "n"), "colloc-totals")
    keys = seen.where("size in (1, 2)").select("key")
    n = keys.count()
    frequent = table(keys, n)
    triples = seen.where("size = 3").select("key")
    frequent_triples = table(triples, triples.count())
    bounds = spark.sparkContext.broadcast(_bounds(texts, max(1, n // PER_RANGE)))

    shards = written(texts.mapInArrow(_shards(rule, frequent, frequent_triples, bounds), _SHARD_COLUMNS), "colloc-shards")
    salted = shards.withColumn("salt", F.pmod(F.xxhash64("packed"), F.lit(_SALTS)))
    groups = salted.repartition(*_PLACE, "salt").sortWithinPartitions(*_PLACE, "salt").drop("salt").mapInArrow(_unite(0), _SHARD_COLUMNS)
    whole = groups.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(_unite(rule.least), _SHARD_COLUMNS)
    return Counts(totals, written(whole, "colloc-transducers"), bounds)


def look_up(counts: Counts, phrases: DataFrame) -> DataFrame:
    """Counts of phrases (lang, phrase: words joined by a space) that the transducers hold: lang, phrase, a."""
    placed = phrases.distinct().mapInArrow(_placed(counts.bounds), "lang string, range int, phrase string")
    asked = placed.groupBy(*_PLACE).agg(F.collect_list("phrase").alias("asked"))  # frequent phrases of one range, as many as its transducer holds
    met = counts.transducers.join(asked, [*_PLACE])
    return met.select("lang", "labels", "packed", "asked").mapInArrow(_looked_up, "lang string, phrase string, a long")


def collocations(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = count(docs, rule)
    phrases = written(counts.transducers.mapInArrow(_listed, "lang string, phrase string, a long"), "colloc-phrases")
    words = F.split("phrase", " ")
    longer = phrases.withColumn("w", words).where("size(w) > 2")
    inside = longer.select("lang", "a", F.explode(F.array(F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.expr("array_join(slice(w, 2, size(w) - 1), ' ')"))).alias("phrase"))
    kept = written(phrases.join(inside.distinct(), ["lang", "phrase", "a"], "left_anti"), "colloc-kept")
    cuts = kept.withColumn("w", words).select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("tail"))
    asked = cuts.select("lang", F.explode(F.array("head", "tail")).alias("phrase"))
    found = written(look_up(counts, asked), "colloc-parts")
    heads, tails = found.selectExpr("lang", "phrase as head", "a as l"), found.selectExpr("lang", "phrase as tail", "a as r")
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(counts.totals, "lang")
    exact = cuts.withColumn("score", F.expr(SCORE))
    lowest = exact.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = lowest.withColumn("_near", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(f"_near <= {rule.top}")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {rule.top}")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
