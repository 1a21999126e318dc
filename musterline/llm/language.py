"""Language identification: words first, character n-grams for words never seen.

A known word scores by its log frequency in each language. An unknown one backs off to its
n-grams of four characters (word ends included), then three, two, one: the longest
length with any known n-gram decides, by the mean over its known ones. A text's language has
the largest sum over its words; the score is its share of the softmax of the sums.

Counts cover every word of every labelled text, and every word seen scores by its own. What tasks
hold is bounded: at most KEPT words and KEPT n-grams of each length (fewer with very many
languages), the most frequent. Where there are more, the rest is a Spark table that `identify` joins with
the distinct words, and n-grams of words never seen, that tasks do not hold; the logs are added as
integers there, so that no order of rows shows.

A word is a run of letters in lower case. A text that is null or has no letter, and every text
where nothing could be learnt, is `und` with score 0. Labels that are null teach nothing. Ties go
to the first language by code point. Texts are read whole, however long. Repeated rows get equal answers, null IDs
are kept, an empty table teaches nothing and gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.llm.tables import written
from musterline.llm.words import mixed, powers, runs_hash

KEPT = 200_000
_CELLS = 8_000_000  # languages times entries of one table
_LONGEST = 4
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_HALF = 0.5  # added to every count
_ONE = 1 << 26  # logs as integers: exact for the 32-bit logs of rare entries


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(len(letter), dtype=np.uint32)
    at = np.flatnonzero(letter)
    lower[at] = np.fromiter((ord(low) if len(low := chr(c).lower()) == 1 else c for c in at.tolist()), np.uint32, len(at))
    return letter, lower


@dataclass
class Words:
    """Of a block of texts: the text, first letter, length and hash of each word; the letters."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    codes: np.ndarray


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    for i, text in enumerate(texts):
        text, lo = text or "", 0
        while lo < len(text):
            hi = min(lo + _BLOCK, len(text))
            while hi < len(text) and text[hi].isalpha():
                hi += 1
            yield i, text[lo:hi]
            lo = hi


def words(texts: list[str | None]) -> Iterator[Words]:
    """All words, in blocks of about _BLOCK characters."""
    held, size = [], 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1]) + 1
        if size >= _BLOCK:
            yield _words(held)
            held, size = [], 0
    if held:
        yield _words(held)


def _words(pieces: list[tuple[int, str]]) -> Words:
    letter, lower = _characters()
    codes = np.frombuffer("\n".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0] + [len(p) + 1 for _, p in pieces[:-1]])
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = letter[codes]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    codes = lower[codes]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes)), out=total[1:])
    down = powers(pow(_BASE, -1, 1 << 64), len(codes))
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) if len(start) else total[:0]
    return Words(np.array([i for i, _ in pieces])[np.searchsorted(begin, start, side="right") - 1], start, end - start, h, codes)


def grams(found: Words, some: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of `some` words, hash) of all their n-grams; from two characters on, word ends are characters."""
    size = found.length[some]
    place = np.arange(int(size.sum()) + len(some) + 1)
    first = np.cumsum(np.append(0, size + 1))[:-1] + 1
    line = np.zeros(len(place), np.uint64)
    at = np.repeat(first - np.cumsum(np.append(0, size))[:-1], size) + np.arange(int(size.sum()))
    line[at] = found.codes[np.repeat(found.start[some] - np.cumsum(np.append(0, size))[:-1], size) + np.arange(int(size.sum()))]
    h = runs_hash(mixed(line + np.uint64(1)), n, n)
    gap = line == 0
    owner = (np.cumsum(gap) - 1)[: len(h)]
    if n == 1:
        good = ~gap[: len(h)]
    else:
        inner = np.cumsum(np.append(0, gap))
        good = (inner[n - 1 : n - 1 + len(h)] - inner[1 : 1 + len(h)]) == 0
    return owner[good], h[good]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, length, hash, n) of words (length 0) and n-grams."""
    schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def settle() -> Iterator[pa.RecordBatch]:
        for (lang, length), parts in held.items():
            h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)
            for lo in range(0, len(h), 100_000):
                part = slice(lo, lo + 100_000)
                m = len(h[part])
                yield pa.record_batch([pa.array([lang] * m), pa.array(np.full(m, length, np.int32)), pa.array(h[part].view(np.int64)), pa.array(n[part])], schema=schema)

    for batch in batches:
        of: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            of.setdefault(lang, []).append(text)
        for lang, texts in of.items():
            for found in words(texts):
                if not len(found.hash):
                    continue
                h, index, n = np.unique(found.hash, return_index=True, return_counts=True)
                held.setdefault((lang, 0), []).append((h, n))
                size += len(h)
                for length in range(1, _LONGEST + 1):
                    owner, g = grams(found, index, length)
                    g, inverse = np.unique(g, return_inverse=True)
                    held.setdefault((lang, length), []).append((g, np.bincount(inverse, n[owner], len(g))))
                    size += len(g)
                if size > 1_000_000:
                    yield from settle()
                    held, size = {}, 0
    yield from settle()


@dataclass
class Table:
    """Sorted hashes and their log frequency in each language."""

    hashes: np.ndarray
    logs: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


@dataclass
class Model:
    """tables by length (0: words). rest: what they leave out (length, hash, logs), null where nothing."""

    languages: list[str]
    tables: dict[int, Table]
    partial: frozenset[int] = frozenset()  # the lengths in rest
    rest: DataFrame | None = None

    def of_words(self, found: Words, first: np.ndarray) -> np.ndarray:
        """A row of language scores for the word at each place in `first`."""
        out = np.zeros((len(first), len(self.languages)))
        at, known = self.tables[0].find(found.hash[first])
        out[known] = self.tables[0].logs[at[known]]
        left = np.flatnonzero(~known)
        for n in range(_LONGEST, 0, -1):
            if not len(left):
                break
            owner, h = grams(found, first[left], n)
            at, known = self.tables[n].find(h)
            owner, at = owner[known], at[known]
            count = np.bincount(owner, minlength=len(left))
            hit = count > 0
            for k in range(len(self.languages)):
                total = np.bincount(owner, self.tables[n].logs[at, k], len(left))
                out[left[hit], k] = total[hit] / count[hit]
            left = left[~hit]
        return out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums by text and language, and the number of words."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for found in words(texts):
            if not len(found.hash):
                continue
            _, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
            each = self.of_words(found, first)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(found.text, each[inverse, k], len(texts))
            n += np.bincount(found.text, minlength=len(texts))
        return total, n


def learn(docs: DataFrame, kept: int = KEPT) -> Model | None:
    """A model from the rows of docs (text, lang) that have a lang."""
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(_tally, "lang string, length int, hash long, n long").groupBy("lang", "length", "hash").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-counts")
    totals = {(r["lang"], r["length"]): r["n"] for r in counts.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, _ in totals})
    if not languages:
        return None
    most = max(1000, min(kept, _CELLS // len(languages)))
    # The least frequency that keeps no more than `most` entries, from a histogram of frequencies.
    step = F.floor(F.log2("n") * 16).alias("step")
    sized = counts.groupBy("length", "hash").agg(F.sum("n").alias("n")).select("length", "hash", step)
    steps = sized.groupBy("length", "step").count().collect()
    tables, partial, bounds, wholes = {}, set(), {}, {}
    for length in range(_LONGEST + 1):
        least, have = None, 0
        own = sorted((r for r in steps if r["length"] == length), key=lambda r: -r["step"])
        size = sum(r["count"] for r in own)
        for r in own:
            have += r["count"]
            if have > most:
                partial.add(length)
                break
            least = r["step"]
        bounds[length] = least
        wholes[length] = np.array([totals.get((x, length), 0) + _HALF * (size + 1) for x in languages])
        if least is None:
            tables[length] = Table(np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32))
            continue
        frequent = sized.where((F.col("length") == length) & (F.col("step") >= least)).select("hash")
        got = counts.where(F.col("length") == length).join(frequent, "hash", "left_semi").select("hash", "lang", "n").toArrow()
        h, inverse = np.unique(got.column("hash").to_numpy().view(np.uint64), return_inverse=True)
        each = np.full((len(h), len(languages)), _HALF)
        each[inverse, np.searchsorted(languages, got.column("lang").to_numpy().astype(str))] += got.column("n").to_numpy()
        tables[length] = Table(h, np.log(each / wholes[length]).astype(np.float32))
    rest = written(_rest(counts, languages, {x: bounds[x] for x in partial}, wholes), "language-rest") if partial else None
    return Model(languages, tables, frozenset(partial), rest)


def _rest(counts: DataFrame, languages: list[str], bounds: dict[int, int | None], wholes: dict[int, np.ndarray]) -> DataFrame:
    """(length, hash, logs) of the entries below the bound of their length; without a bound, of all."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = batch.column("seen")
            each = np.full((batch.num_rows, len(languages)), _HALF)
            row = np.repeat(np.arange(batch.num_rows), seen.value_lengths().to_numpy())
            langs, n = seen.flatten().flatten()
            each[row, np.searchsorted(languages, langs.to_numpy(zero_copy_only=False).astype(str))] += n.to_numpy()
            length = batch.column("length").to_numpy()
            for k in np.unique(length).tolist():
                each[length == k] /= wholes[k]
            yield pa.record_batch([batch.column("length"), batch.column("hash"), _longs(np.log(each).astype(np.float32))], names=["length", "hash", "logs"])

    rare = " or ".join(f"length = {length}" + ("" if least is None else f" and floor(log2(n) * 16) < {least}") for length, least in sorted(bounds.items()))
    entries = counts.groupBy("length", "hash").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("seen"))
    return entries.where(rare).select("length", "hash", "seen").mapInArrow(dense, "length int, hash long, logs array<long>")


def _longs(logs: np.ndarray) -> pa.Array:
    """Rows of logs as lists of integers."""
    at = np.arange(len(logs) + 1, dtype=np.int32) * logs.shape[1]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.rint(logs.astype(np.float64) * _ONE).astype(np.int64).reshape(-1)))


_ANSWER = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def _answers(languages: list[str], total: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of texts by their sums and numbers of words."""
    best = total.argmax(1)
    share = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
    return [languages[k] if m else "und" for k, m in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, share, 0)


def predictor(spark: SparkSession, model: Model | None) -> Callable[[Column], Column]:
    """A column function from text to a struct (lang_pred, score), for a model that tasks hold as a whole."""
    if model is not None and model.rest is not None:
        raise ValueError("the model has more entries than tasks hold: use identify")
    shared = spark.sparkContext.broadcast(model)

    def predict(column: pa.Array) -> pa.Array:
        model = shared.value
        names, scores = ["und"] * len(column), np.zeros(len(column))
        if model is not None:
            for lo in range(0, len(column), 500):
                part = slice(lo, min(lo + 500, len(column)))
                names[part], scores[part] = _answers(model.languages, *model.scores(column.slice(lo, 500).to_pylist()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], fields=list(_ANSWER))

    return F.arrow_udf(predict, "lang_pred string, score double")


_WORD = pa.struct([("hash", pa.int64()), ("n", pa.int64()), ("word", pa.string())])
_SCANNED = pa.struct([("total", pa.list_(pa.float64())), ("n", pa.int64()), ("open", pa.list_(_WORD))])


def _scanner(shared) -> Callable[[Column], Column]:
    """A column function from text to the sums over its words in the table, its number of words, and its other words."""

    def some(model: Model, texts: list[str | None]) -> pa.Array:
        total, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
        owner, h, count, spelt = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for found in words(texts):
            if not len(found.hash):
                continue
            n += np.bincount(found.text, minlength=len(texts))
            each, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
            at, known = model.tables[0].find(each)
            held = known[inverse]
            for k in range(len(model.languages)):
                total[:, k] += np.bincount(found.text[held], model.tables[0].logs[at[inverse[held]], k], len(texts)) if held.any() else 0
            pairs, times = np.unique(found.text[~held] * len(each) + inverse[~held], return_counts=True)
            which = pairs % len(each)
            owner.append(pairs // len(each))
            h.append(each[which])
            count.append(times)
            named = {x: found.codes[(lo := found.start[first[x]]) : lo + found.length[first[x]]].tobytes().decode("utf-32-le") for x in np.unique(which).tolist()}
            spelt += [named[x] for x in which.tolist()]
        owner, h, count = (np.concatenate(x) for x in (owner, h, count))
        order = np.argsort(owner, kind="stable")
        at = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int32)
        left = pa.StructArray.from_arrays([pa.array(h[order].view(np.int64)), pa.array(count[order]), pa.array(spelt, pa.string()).take(pa.array(order))], fields=list(_WORD))
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.reshape(-1)))
        return pa.StructArray.from_arrays([sums, pa.array(n), pa.ListArray.from_arrays(pa.array(at), left)], fields=list(_SCANNED))

    def scan(column: pa.Array) -> pa.Array:
        found = [some(shared.value, column.slice(lo, 500).to_pylist()) for lo in range(0, len(column), 500)]
        return pa.concat_arrays(found) if found else pa.array([], _SCANNED)

    return F.arrow_udf(scan, "total array<double>, n long, open array<struct<hash: long, n: long, word: string>>")


_LEVELS = pa.schema([("hash", pa.int64()), ("length", pa.int32()), ("gram", pa.int64()), ("known", pa.int64()), ("logs", pa.list_(pa.int64()))])


def _levels(shared):
    """What the tables know of the n-grams of each word, by length down to the first they know any of.

    The sums of `known` n-grams, where there are any; and each n-gram that may be in the rest.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            name = batch.column("hash").to_numpy()
            for found in words(batch.column("word").to_pylist()):
                left = np.arange(len(found.hash))
                for n in range(_LONGEST, 0, -1):
                    if not len(left):
                        break
                    word = name[found.text[left]]
                    owner, h = grams(found, left, n)
                    at, known = model.tables[n].find(h)
                    if n in model.partial:
                        more = word[owner[~known]]
                        none = pa.nulls(len(more), pa.int64())
                        yield pa.record_batch([pa.array(more), pa.array(np.full(len(more), n, np.int32)), pa.array(h[~known].view(np.int64)), none, pa.nulls(len(more), pa.list_(pa.int64()))], schema=_LEVELS)
                    owner, at = owner[known], at[known]
                    count = np.bincount(owner, minlength=len(left))
                    hit = count > 0
                    if hit.any():
                        total = np.stack([np.bincount(owner, model.tables[n].logs[at, k], len(left)) for k in range(len(model.languages))], 1)[hit]
                        m = len(total)
                        yield pa.record_batch([pa.array(word[hit]), pa.array(np.full(m, n, np.int32)), pa.nulls(m, pa.int64()), pa.array(count[hit]), _longs(total)], schema=_LEVELS)
                    left = left[~hit]

    return task


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of docs but text, and a struct p (lang_pred, score) of the text."""
    spark, own = docs.sparkSession, [x for x in docs.columns if x != "text"]
    if model is None or model.rest is None:
        return docs.select(*own, predictor(spark, model)(F.col("text")).alias("p"))
    languages, rest = model.languages, model.rest
    shared = spark.sparkContext.broadcast(replace(model, rest=None))
    rows = written(docs.select(F.struct(*own).alias("own"), _scanner(shared)(F.col("text")).alias("s"), F.monotonically_increasing_id().alias("row")), "language-rows")
    spread = rows.select("row", F.explode("s.open").alias("w")).select("row", "w.hash", "w.n", "w.word")

    # Each distinct word once: with its logs if it was seen, else by its n-grams.
    once = spread.groupBy("hash").agg(F.first("word").alias("word"))
    once = written(once.join(rest.where("length = 0").select("hash", "logs"), "hash", "left"), "language-words")
    levels = written(once.where("logs is null").select("hash", "word").mapInArrow(_levels(shared), "hash long, length int, gram long, known long, logs array<long>"), "language-levels")
    looked = levels.where("gram is not null").select("hash", "length", "gram").join(rest.withColumnRenamed("hash", "gram"), ["length", "gram"])
    looked = looked.select("hash", "length", F.lit(1).cast("long").alias("known"), "logs")

    def summed(times: Column) -> Column:
        return F.array(*(F.sum(F.get("logs", F.lit(k)) * times) for k in range(len(languages))))

    met = levels.where("gram is null").select("hash", "length", "known", "logs").unionByName(looked)
    met = met.groupBy("hash", "length").agg(F.sum("known").alias("known"), summed(F.lit(1)).alias("logs"))
    met = met.select("hash", "length", F.transform("logs", lambda x: F.round(x / F.col("known")).cast("long")).alias("logs"))
    unseen = met.groupBy("hash").agg(F.max_by("logs", "length").alias("logs"))
    scored = once.where("logs is not null").select("hash", "logs").unionByName(unseen)
    more = spread.select("row", "hash", "n").join(scored, "hash").groupBy("row").agg(summed(F.col("n")).alias("more"))

    def answer(total: pa.Array, n: pa.Array, more: pa.Array) -> pa.Array:
        sums = total.flatten().to_numpy().reshape(len(n), len(languages)).copy()
        sums[more.is_valid().to_numpy(zero_copy_only=False)] += more.flatten().to_numpy().reshape(-1, len(languages)) / _ONE
        names, scores = _answers(languages, sums, n.to_numpy())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], fields=list(_ANSWER))

    answered = F.arrow_udf(answer, "lang_pred string, score double")
    return rows.join(more, "row", "left").select(*(F.col("own").getField(x).alias(x) for x in own), answered("s.total", "s.n", "more").alias("p"))
