from pyspark.sql import functions as F

from musterline import functions as fn


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression.alias("y")).collect()]


def test_strip_agrees_with_python_on_every_white_space_character(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert len(spaces) == 29
    values = [s + "a" + s for s in spaces] + ["a​", "﻿a", " a b ", "", "\t\n"]
    assert column(spark, values, fn.strip("x")) == [v.strip() for v in values]


def test_clean_id_turns_blank_into_null(spark):
    assert column(spark, ["\xa0", "", None, " 007 "], fn.clean_id("x")) == [None, None, None, "007"]


def test_blank_email_is_missing_but_blank_department_is_kept(spark):
    values = [None, "", " ", "\t", "a@b"]
    assert column(spark, values, fn.email_missing("x")) == [True, True, True, True, False]
    assert column(spark, values, fn.department_or_unknown("x")) == ["Unknown", "Unknown", " ", "\t", "a@b"]


def test_round2_equals_python_round_for_all_small_ratios(spark):
    pairs = spark.range(1, 401).select(F.col("id").alias("n")).withColumn(
        "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))
    )
    rows = pairs.select("m", "n", fn.score(F.col("m"), F.col("n")).alias("s")).collect()
    assert len(rows) == sum(n + 1 for n in range(1, 401))
    assert [r for r in rows if r.s != round(r.m / r.n * 100, 2)] == []


def test_score_of_an_empty_roster_is_zero_and_prints_without_decimals(spark):
    row = spark.range(1).select(
        fn.score(F.lit(0), F.lit(0)).alias("s"),
        fn.score_text(F.lit(0.0), F.lit(0)).alias("none"),
        fn.score_text(F.lit(0.0), F.lit(3)).alias("zero"),
        fn.score_text(F.lit(95.0), F.lit(3)).alias("high"),
    ).first()
    assert tuple(row) == (0.0, "0", "0.0", "95.0")


def test_risk_bands_use_the_rounded_score(spark):
    values = [100.0, 95.0, 94.99, 80.0, 79.99, 0.0]
    assert column(spark, values, fn.risk_level(F.col("x")), "double") == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"
    ]
    # 94.995 rounds to 94.99 or 95.0 first, and only then falls into a band.
    assert column(spark, [94.996], fn.risk_level(fn.round2(F.col("x"))), "double") == ["LOW"]


def test_recommendations(spark):
    df = spark.createDataFrame([(1, 0, 2), (0, 0, 0), (0, 3, 0)], "m int, u int, e int")
    codes = [r[0] for r in df.select(fn.recommendation_codes(F.col("m"), F.col("u"), F.col("e"))).collect()]
    assert codes == [["REVIEW_MISSING", "FIX_EMAIL"], ["NO_ISSUES"], ["VERIFY_UNKNOWN"]]


def test_executive_codes_carry_counts_and_the_target_rule(spark):
    df = spark.createDataFrame([(1, 0, 2, 89.99), (0, 0, 0, 90.0)], "m int, u int, e int, s double")
    codes = [
        r[0] for r in df.select(fn.executive_codes(F.col("m"), F.col("u"), F.col("e"), F.col("s"))).collect()
    ]
    assert codes == [["REVIEW_MISSING:1", "FIX_EMAIL:2", "BELOW_TARGET"], ["NO_ISSUES"]]


def test_extension_and_type(spark):
    names = ["a.CSV", "d.x/b.xls", ".profile", "name.", "name", "..csv", "a..csv", "x/.csv", "t.tar.JPEG", None]
    assert column(spark, names, fn.extension("x")) == [
        ".csv", ".xls", "", "", "", "", ".csv", "", ".jpeg", None
    ]
    assert column(spark, names, fn.file_type(fn.extension("x"))) == [
        "CSV", "EXCEL", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "CSV", "UNKNOWN", "IMAGE", "UNKNOWN"
    ]


def test_sanitized_keeps_the_base_name_only(spark):
    names = ["../../etc/pass wd.csv", "näme(1).csv", "ok-1_2.csv", "dir/"]
    assert column(spark, names, fn.sanitized("x")) == ["pass_wd.csv", "n_me_1_.csv", "ok-1_2.csv", ""]


def test_search_pattern_wildcards_stay_live_unless_literal(spark):
    values = ["axb", "a_b", "A_B", "100%", None]
    assert column(spark, values, fn.contains_any(["x"], "a_b")) == [True, True, True, False, False]
    assert column(spark, values, fn.contains_any(["x"], "a_b", literal=True)) == [False, True, True, False, False]
    assert column(spark, values, fn.contains_any(["x"], "%", literal=True)) == [False, False, False, True, False]


def test_search_with_backslashes(spark):
    values = ["a\\b", "ab", "a%b", "axb"]
    assert column(spark, values, fn.contains_any(["x"], "a\\b")) == [False, True, False, False]
    assert column(spark, values, fn.contains_any(["x"], "a\\%b")) == [False, False, True, False]
    assert column(spark, values, fn.contains_any(["x"], "a\\\\b")) == [True, False, False, False]
    assert column(spark, values, fn.contains_any(["x"], "a\\b", literal=True)) == [True, False, False, False]


def test_timestamp_suffix(spark):
    clock = F.lit("2024-03-04 05:06:07").cast("timestamp_ntz")
    assert spark.range(1).select(fn.timestamp_suffix(clock)).first()[0] == "20240304_050607"
