"""Score, banding, recommendation codes."""

from pyspark.sql import Column, functions as F

from musterline import constants as K


def round2(c: Column) -> Column:
    """Round half-even on the exact binary value, to two decimals.

    ``round`` and ``bround`` both go through a shortest-decimal step and differ from this
    for some ratios; ``format_number`` with a pattern does not.
    """
    return F.call_function("format_number", c, F.lit("0.00")).cast("double")


def score(matched: Column, total: Column) -> Column:
    """Percent matched; 0 for an empty roster (the guard also keeps ANSI mode from raising)."""
    ratio = matched.cast("double") / F.when(total != 0, total.cast("double")) * 100
    return F.when(total == 0, F.lit(0.0)).otherwise(round2(ratio))


def risk_level(rounded_score: Column) -> Column:
    return (
        F.when(rounded_score >= K.LOW_RISK_FROM, K.RISK_LOW)
        .when(rounded_score >= K.MEDIUM_RISK_FROM, K.RISK_MEDIUM)
        .otherwise(K.RISK_HIGH)
    )


def score_text(rounded_score: Column, total: Column) -> Column:
    """``95.0``, but a bare ``0`` where there is no roster to score."""
    return F.when(total == 0, "0").otherwise(rounded_score.cast("string"))


def _codes_or_default(codes: list[Column]) -> Column:
    found = F.array_compact(F.array(*codes))
    return F.when(F.size(found) == 0, F.array(F.lit(K.NO_ISSUES))).otherwise(found)


def recommendation_codes(missing: Column, unknown: Column, missing_email: Column) -> Column:
    return _codes_or_default([
        F.when(missing > 0, K.REVIEW_MISSING),
        F.when(unknown > 0, K.VERIFY_UNKNOWN),
        F.when(missing_email > 0, K.FIX_EMAIL),
    ])


def executive_codes(
    missing: Column, unknown: Column, missing_email: Column, rounded_score: Column
) -> Column:
    """Codes carrying their counts (``CODE:n``) plus the below-target rule."""

    def counted(code: str, n: Column) -> Column:
        return F.when(n > 0, F.concat(F.lit(code + ":"), n.cast("string")))

    return _codes_or_default([
        counted(K.REVIEW_MISSING, missing),
        counted(K.VERIFY_UNKNOWN, unknown),
        counted(K.FIX_EMAIL, missing_email),
        F.when(rounded_score < K.TARGET_SCORE, K.BELOW_TARGET),
    ])


def advice_text(code: Column) -> Column:
    """Our sentence for a recommendation code."""
    table = F.create_map(*[F.lit(x) for pair in K.ADVICE.items() for x in pair])
    return F.element_at(table, code)
