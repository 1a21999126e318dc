"""Token counts from an exact histogram of encoded lengths.

Every text is encoded in whole; what is kept is the number of documents of each length. Sums over the
histogram then answer, for every context limit at once, how many documents and tokens there
are, how many tokens are left when texts are truncated to the limit, and any quantile.

Texts go through the tokenizer once and whole, however long, never a sample of them. A null or empty text has
length 0 and counts as a document; repeated rows count each, and ties are one row. An empty table
gives an empty histogram. Only the text column is read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.llm.tables import written

_BLOCK = 1024


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary (a file of base64 token and rank a line) that every executor can read at `path`."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    # fixed value: how texts are split before merging, as published with this vocabulary
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _encoding(tokenizer: Tokenizer):
    import tiktoken

    with open(tokenizer.path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizer.pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(tokenizer: Tokenizer = Tokenizer()) -> Callable[[Column], Column]:
    """A column function from text to its number of tokens."""

    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(tokenizer).encode_ordinary
        return pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in texts], pa.int64())

    return F.arrow_udf(count, "long")


def histogram(lengths_: DataFrame) -> DataFrame:
    """One row for each length that occurs in `length`:

    n_docs and n_tokens of that length; docs_from and tokens_from of that length or more;
    truncated_tokens, all tokens when texts are cut to that length; docs_share, the share of
    documents of that length or less.
    """
    # Written, as both readers below would encode every text again.
    counts = written(lengths_.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.expr(f"length div {_BLOCK}")})
    # Suffix sums in two steps: within blocks of lengths, and over the few blocks.
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = "over (order by block desc rows between unbounded preceding and 1 preceding)"
    blocks = blocks.select("block", *(F.expr(f"coalesce(sum({x}) {later}, 0)").alias(f"{x}_later") for x in "dt"), *(F.expr(f"sum({x}) over ()").alias(f"{x}_all") for x in "dt"))
    own = "over (partition by block order by length desc)"
    out = counts.join(blocks, "block").withColumns({"docs_from": F.expr(f"d_later + sum(n_docs) {own}"), "tokens_from": F.expr(f"t_later + sum(n_tokens) {own}")})
    return out.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from",
        F.expr("t_all - tokens_from + length * docs_from").alias("truncated_tokens"),
        F.expr("(d_all - docs_from + n_docs) / d_all").alias("docs_share"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_within, truncated_tokens) for each limit: from the least length beyond it, or all where none is."""
    beyond = [F.max(F.when(F.col("length") > n, F.struct("docs_from", "tokens_from"))).alias(str(i)) for i, n in enumerate(limits)]
    one = sums.agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"), *beyond)
    over, more = (lambda i: F.coalesce(F.col(f"{i}.docs_from"), F.lit(0))), (lambda i: F.coalesce(F.col(f"{i}.tokens_from"), F.lit(0)))
    rows = [F.struct(F.lit(n).cast("long").alias("limit"), (F.col("docs") - over(i)).alias("docs_within"), (F.col("tokens") - more(i) + n * over(i)).alias("truncated_tokens")) for i, n in enumerate(limits)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of documents does not exceed."""
    one = sums.agg(*(F.min(F.when(F.col("docs_share") >= s, F.col("length"))).alias(str(i)) for i, s in enumerate(shares)))
    return one.select(F.explode(F.array([F.struct(F.lit(s).alias("share"), F.col(str(i)).alias("length")) for i, s in enumerate(shares)])).alias("x")).select("x.*")
