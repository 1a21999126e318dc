"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are counted by membership pattern, so the
network has a node for each pattern and each source, not for each document. Words flow from a
pattern to the sources it belongs to; a pattern can give its words up to `most` times, and every
further repetition costs more than the one before (1, 3, 5, ...), so the flow with the least
cost repeats as little as it can. Sources take their target: shares of `total` times all words by
weight, at most `most` times the source's words, the excess shared anew by weight.

A pattern that gives w words of its n takes every document w // n times, and once more the first
documents by a seeded hash of the ID up to the rest; the document at the limit gives what is left.
This needs one cut per pattern, found from words per hash range, so documents are neither
sorted nor numbered, and any number of them may be of one pattern.

Sources and targets are Spark tables. A pattern of one source that no other pattern shares has nothing to
route: it gives what its source takes, by a join. Only patterns that overlap, and the others of their
sources, reach the driver as a network; more than PATTERNS of these are refused.

A null or empty text has 0 words and gives none; a null source is a source, the last by
order; no sources at all gives nothing. A null ID hashes as the empty text; rows of equal ID at the
limit share what is left evenly. An empty table has an empty mix. Columns of the input are kept;
those named like a column of the result are replaced.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.llm.tables import written
from musterline.operators.numbering import numbered

PATTERNS = 1_000_000
_RANGES = 1 << 12
_BITS = 60

Source = str | None


def cycle(weights: tuple[float, ...] = (5, 2, 1)) -> Callable[[Column], Column]:
    """Weights in turn: from a source's place in order (0 the first) to its weight."""
    return lambda place: F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))


def targets(sources: DataFrame, weigh: Callable[[Column], Column], total: float, most: int) -> DataFrame:
    """sources (source, source_size) with `target`: shares of `total` by weight; none above `most` times its size, the excess shared anew until none is above.

    Sources are in order of code point, null last. Each round is one sum over them; what is full stays full.
    """
    ordered = sources.select("source", "source_size", F.lit(0).alias("all"), F.col("source").isNull().alias("last"))
    placed = numbered(ordered, ["all"], ["last", "source"], "place").withColumn("weight", weigh(F.col("place") - 1)).withColumn("full", F.lit(most) * F.col("source_size"))
    placed = written(placed.select("source", "source_size", "weight", F.col("full").cast("double").alias("full")), "weights")
    left, unit, full = total, None, -1
    while True:
        is_full = F.lit(False) if unit is None else F.col("weight") * unit > F.col("full")
        r = placed.agg(F.count_if(is_full).alias("n"), F.sum(F.when(is_full, F.col("full"))).alias("given"), F.sum(F.when(~is_full, F.col("weight"))).alias("weight")).first()
        if r["n"] == full:
            break
        full, left = r["n"], total - (r["given"] or 0.0)
        if not r["weight"]:
            unit = float("inf")
            break
        unit = max(left / r["weight"], unit or 0.0)
    return placed.select("source", "source_size", F.least(F.col("full"), F.col("weight") * unit).alias("target"))


def flow(sizes: dict[str, int], members: dict[str, list[Source]], quotas: dict[Source, int], most: int) -> dict[tuple[str, Source], int]:
    """Words from pattern to source: the largest flow of the least cost, cheapest path first."""
    out: dict[tuple[str, Source], int] = defaultdict(int)
    of = defaultdict(list)
    for p, own in members.items():
        for s in own:
            of[s].append(p)
    seen: set[str] = set()
    for start in sorted(members):
        if start in seen:
            continue
        group, todo = [], [start]  # the patterns that share sources, directly or not
        seen.add(start)
        while todo:
            group.append(p := todo.pop())
            for q in (q for s in members[p] for q in of[s] if q not in seen):
                seen.add(q)
                todo.append(q)
        if len(group) == 1 and len(members[start]) == 1:
            s = members[start][0]
            out[start, s] = min(quotas[s], most * sizes[start])
            continue
        _cheapest(sorted(group), sizes, members, quotas, most, out)
    return dict(out)


def _cheapest(group, sizes, members, quotas, most, out) -> None:
    given = dict.fromkeys(group, 0)
    need = {s: quotas[s] for p in group for s in members[p]}
    takers = {s: [p for p in group if s in members[p]] for s in need}
    while True:
        # Cheapest way from a pattern with words left to a source in need, along flow that can be turned back.
        cost = {p: 2 * (given[p] // sizes[p]) + 1 for p in group if given[p] < most * sizes[p]}
        came, found = {}, None
        for p in sorted(cost, key=lambda p: (cost[p], p)):
            if p in came:
                continue
            came[p] = None
            line = deque([p])
            while line and found is None:
                q = line.popleft()
                for s in members[q]:
                    if ("s", s) in came:
                        continue
                    came["s", s] = q
                    if need[s] > 0:
                        found = s
                        break
                    for r in takers[s]:
                        if r not in came and out[r, s] > 0:
                            came[r] = s
                            line.append(r)
            if found is not None:
                break
        if found is None:
            return
        path, s = [], found
        while True:
            q = came["s", s]
            path.append((q, s))
            if came[q] is None:
                break
            s = came[q]
            path.append((q, s))
        first = path[-1][0]
        step = min(need[found], sizes[first] - given[first] % sizes[first], *[out[e] for e in path[1::2]])
        for i, e in enumerate(path):
            out[e] += -step if i % 2 else step
        given[first] += step
        need[found] -= step


@dataclass(frozen=True)
class Mix:
    """documents: the input with size and taken. sources: source, source_size, target. routes: pattern, source, words."""

    documents: DataFrame
    sources: DataFrame
    routes: DataFrame


def _order(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def _routes(patterns: DataFrame, sources: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Words given by each pattern (_pattern, size, given), and from pattern to source."""
    spark = patterns.sparkSession
    members = patterns.select("_pattern", "size", "of", F.explode("of").alias("source"))
    shared = written(members.where("size(of) > 1 and size > 0").select("source").distinct(), "shared")
    met = members.join(shared.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    tied = met.groupBy("_pattern", "size", "of").agg(F.bool_or(F.col("s").isNotNull() | (F.size("of") > 1)).alias("tied"), F.bool_or(F.col("source").isNull()).alias("_null"))
    null_shared = not shared.where("source is null").isEmpty()
    tied = written(tied.select("_pattern", "size", "of", (F.col("tied") | (F.col("_null") & F.lit(null_shared))).alias("tied")), "tied")

    alone = tied.where("not tied").select("_pattern", "size", F.col("of")[0].alias("source"))
    wanted = sources.select(F.col("source").alias("s"), F.floor("target").cast("long").alias("quota"))
    alone = alone.join(wanted, F.col("source").eqNullSafe(F.col("s"))).select("_pattern", "size", "source", F.least("quota", most * F.col("size")).alias("words"))

    network = tied.where("tied and size > 0").limit(PATTERNS + 1).collect()
    if len(network) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} overlapping membership patterns")
    sizes, of = {r["_pattern"]: r["size"] for r in network}, {r["_pattern"]: r["of"] for r in network}
    used = spark.createDataFrame([(s,) for s in {s for own in of.values() for s in own}], "u string")
    quotas = {r["s"]: r["quota"] for r in wanted.join(used, F.col("s").eqNullSafe(F.col("u"))).collect()}  # sources of the network only
    found = flow(sizes, of, quotas, most)
    given: dict[str, int] = defaultdict(int)
    for (p, _), words in found.items():
        given[p] += words
    plan = spark.createDataFrame([(p, n, given[p]) for p, n in sizes.items()], "_pattern string, size long, given long")
    routes = spark.createDataFrame([(p, s, n) for (p, s), n in found.items()], "pattern string, source string, words long")
    return alone.selectExpr("_pattern", "size", "words as given").union(plan), alone.selectExpr("_pattern as pattern", "source", "words").union(routes)


def mix(docs: DataFrame, sources: Column, weigh: Callable[[Column], Column] = cycle(), total: float = 1.5, most: int = 2) -> Mix:
    """docs (doc_id, text, ...) with `sources`, an array of the sources of each document."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    of = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    # The row travels as one value, whatever its columns are called.
    keyed = docs.select(size.alias("size"), F.to_json(of).alias("_pattern"), of.alias("of"), _order(F.col("doc_id")).alias("_order"), F.struct(*docs.drop("size", "taken").columns).alias("row"))
    sized = written(keyed.select("size", "_pattern", "of", "_order"), "sized")

    patterns = written(sized.groupBy("_pattern", "of").agg(F.sum("size").alias("size")), "patterns")
    whole = patterns.select("size", F.explode("of").alias("source")).groupBy("source").agg(F.sum("size").alias("source_size"))
    all_words = patterns.agg(F.sum("size")).first()[0] or 0
    wanted = targets(whole, weigh, total * all_words, most)
    plan, routes = _routes(patterns, wanted, most)

    # The cut of each pattern: from words per hash range, then inside the one range that has it.
    plan = written(plan.where("size > 0").selectExpr("_pattern", "given div size as passes", "given % size as rest"), "plan")
    taken_from = sized.where("size > 0")
    ranges = taken_from.groupBy("_pattern", F.shiftright("_order", _BITS - 12).alias("r")).agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("until", F.expr("sum(words) over (partition by _pattern order by r)")).join(plan, "_pattern")
    ranges = written(ranges.where("until - words <= rest and rest < until").selectExpr("_pattern", "r", "passes", "rest - (until - words) as rest"), "ranges")
    inside = taken_from.withColumn("r", F.shiftright("_order", _BITS - 12)).join(ranges, ["_pattern", "r"])
    inside = inside.groupBy("_pattern", "passes", "rest", "_order").agg(F.sum("size").alias("words"), F.count("*").alias("equal"))
    inside = inside.withColumn("until", F.expr("sum(words) over (partition by _pattern order by _order)"))
    cuts = written(inside.where("until - words <= rest and rest < until").selectExpr("_pattern", "passes", "_order as cut", "(rest - (until - words)) div equal as part"), "cuts")
    once = F.expr("case when _order < cut then size when _order = cut then least(size, part) else 0 end")
    documents = keyed.drop("of").join(cuts, "_pattern", "left").withColumn("taken", F.coalesce(F.col("size") * F.col("passes") + once, F.lit(0)))
    return Mix(documents.select("row.*", "size", "taken"), wanted, routes)
