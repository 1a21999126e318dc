"""Shards of bounded size by extendible hashing.

Every document has BITS bits from the MD5 of its ID and text. The directory begins with one
bucket; only a bucket of more bytes than the limit splits, on its next bit, until every bucket
fits. The directory has a slot for each prefix of as many bits as the deepest bucket has, and
each slot names its bucket.

Splitting works on bytes per prefix: documents are read once, and the bytes of a prefix are
those of its two longer ones. A bucket that has used all bits and is still too large holds
equal rows (same ID and text), or one row beyond the limit. Equal rows are dealt to overflow
pages of as many as fit, and a row beyond the limit has a page of its own, `oversized`.

A null or empty text has 0 bytes; a null ID hashes as the empty text. An empty table has
no shards. Columns of the input are kept; those named like a column of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.llm.tables import written

BITS = 60
LIMIT = 16 << 20
_STEP = 12
_WIDTH = 20  # the directory that tasks hold has 2**20 slots at most; deeper buckets are joined
_DEALT = 64
NAMES = ["shard", "depth", "page", "bytes", "oversized"]


def _hash(doc_id: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 as 60 bits."""
    joined = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def buckets(sized: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, total) of every bucket over (hash, bytes)."""
    spark = sized.sparkSession
    whole = sized.agg(F.sum("bytes")).first()[0]
    if whole is None or whole <= limit:
        return spark.range(0 if whole is None else 1).select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), F.lit(whole).cast("long").alias("total"))
    left, done = written(sized.groupBy("hash").agg(F.sum("bytes").alias("bytes")), "hashes"), []
    for depth in range(0, BITS, _STEP):
        # Bytes of every prefix of up to _STEP further bits, and of the prefix one bit shorter.
        until = depth + _STEP
        longest = left.groupBy(F.shiftright("hash", BITS - until).alias("p")).agg(F.sum("bytes").alias("bytes"))
        each = F.explode(F.array([F.struct(F.lit(d).alias("depth"), F.shiftright("p", until - d).alias("prefix")) for d in range(depth + 1, until + 1)]))
        levels = longest.select(each.alias("x"), "bytes").groupBy("x.depth", "x.prefix").agg(F.sum("bytes").alias("total"))
        levels = levels.withColumn("parent", F.expr("sum(total) over (partition by depth, shiftright(prefix, 1))"))
        levels = written(levels.where(f"parent > {limit}"), "levels")
        done.append(levels.where(f"total <= {limit} or depth = {BITS}").select("prefix", "depth", "total"))
        large = levels.where(f"total > {limit} and depth = {until} and depth < {BITS}").select(F.col("prefix").alias("q"))
        if large.isEmpty():
            break
        left = written(left.join(large, F.shiftright("hash", BITS - until) == F.col("q"), "left_semi"), "hashes")
    for more in done[1:]:
        done[0] = done[0].union(more)
    return done[0]


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text, ...) with the shard of each row: its prefix as bits, depth, page, bytes, oversized.

    One file holds the rows of one (shard, page). The page is 0 but in overflowing buckets.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # The row travels as one value, whatever its columns are called.
    keyed = docs.select(_hash(F.col("doc_id"), F.col("text")).alias("hash"), size.alias("bytes"), F.struct(*docs.drop(*NAMES).columns).alias("row"))
    found = written(buckets(written(keyed.select("hash", "bytes"), "sized"), limit), "buckets")
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())  # BITS + 1 at most
    width = min(depths[-1] if depths else 0, _WIDTH)
    slots = found.where(f"depth <= {width}").select(
        F.explode(F.expr(f"sequence(shiftleft(prefix, {width} - depth), shiftleft(prefix + 1, {width} - depth) - 1)")).alias("slot"), "depth", "total"
    )
    keyed = keyed.withColumn("slot", F.shiftright("hash", BITS - width))
    placed = keyed.join(F.broadcast(slots), "slot", "left")  # 2**_WIDTH slots at most
    if depths and depths[-1] > width:
        deep = F.explode(F.array([F.lit(d) for d in depths if d > width]))
        below = found.where(f"depth > {width}").withColumnsRenamed({"depth": "own_depth"})
        rest = placed.where("depth is null").drop("depth", "total").withColumn("depth", deep)
        rest = rest.join(below, (F.col("depth") == F.col("own_depth")) & (F.expr(f"shiftright(hash, {BITS} - depth)") == F.col("prefix"))).drop("own_depth", "prefix")
        placed = placed.where("depth is not null").unionByName(rest)
    placed = placed.withColumns({
        "shard": F.expr(f"substring(lpad(bin(hash), {BITS}, '0'), 1, depth)"),
        "oversized": F.col("bytes") > limit,
        "page": F.lit(0).cast("long"),
    })
    if depths and depths[-1] == BITS:
        # Equal rows in runs of as many as fit; dealt out first, so that no task gets all of them.
        full = F.expr(f"depth = {BITS} and total > {limit}")
        over = placed.where(full).withColumn("deal", F.monotonically_increasing_id() % _DEALT)
        nth = F.expr("row_number() over (partition by hash, deal order by bytes)") - 1
        over = over.withColumn("page", F.col("deal") + _DEALT * F.floor(nth / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes")))))
        placed = placed.where(~full).unionByName(over.drop("deal"))
    return placed.select("row.*", *NAMES)
