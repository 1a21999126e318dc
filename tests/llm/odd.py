"""Documents with everything that should not disturb an operator."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def prose(seed, n, vocabulary=400):
    rand = random.Random(seed)
    return " ".join(f"w{rand.randrange(vocabulary)}x" for _ in range(n))


def rows():
    base, shared = prose(1, 120), prose(2, 60, 5000)
    near = base.split()
    near[50] = "changed"
    out = [
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 1),  # exact copy
        (3, " ".join(near), "en", None, 1),  # near copy
        (4, base.upper(), "en", "a", 1),
        (5, None, "en", "a", None),
        (6, "", None, "b", 0),
        (7, " \t\n\x0b", "de", "", 3),
        (8, "one two", "de", "a", 7),
        (9, "ONE two", "de", "a", 7),
        (10, prose(3, 100) + " " + shared, "en", "c", 1),
        (11, shared + "\n" + prose(4, 90), "en", "c", 1),
        (12, prose(5, 30_000, 900), "fr", "a", 1),  # very long
        (13, "be " * 300, "en", "a", 1),  # periodic
        (14, "é" * 900 + " über ñandú 東京", "es", "é", 1),
        (15, "x" * 3000, "en", "a", 1),  # one word
        (None, prose(6, 80), "en", "a", 1),
        (None, None, None, None, None),
        (16, prose(7, 50), "de", "c", 1),
        (16, prose(7, 50), "de", "c", 1),  # repeated row
        (17, prose(8, 70), "de", "c", 1),
        (17, prose(9, 70), "de", "d", 1),  # same ID, other text
    ]
    return out


def frame(spark, parts=3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Extra columns that are called like what operators use inside or return."""
    names = ["class", "n", "l", "token", "row_key", "a", "b", "size", "taken", "shard", "depth", "page", "bytes", "hash", "slot", "total", "prefix", "row", "cut", "part", "rest", "passes", "score", "label", "anchor", "start", "count", "fingerprint", "own", "item_id", "span", "_row_key", "_pattern", "_order", "top", "id", "key", "of", "d", "k", "range", "page_id", "html", "digest", "first", "turn", "role", "conv_id", "at", "fault"]
    return docs.withColumns({x: F.lit(7) for x in names if x not in docs.columns})
