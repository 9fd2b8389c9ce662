"""Scalar rules: golden rows, bin edges, rounding and null conventions."""

import pytest
from pyspark.sql import functions as F

from retenta.functions import expr as X


def one(spark, expr_fn, values, schema):
    df = spark.createDataFrame(values, schema)
    return [r[0] for r in df.select(expr_fn(df)).collect()]


# login, sat, prods, days without tx -> score, band  (hand-computed)
GOLDEN = [
    (45, 3.0, 0, None, 76.9, "Alto"),
    (0, 10.0, 5, 0, 0.0, None),
    (200, 1.0, 0, 400, 100.0, "Alto"),
    (90, 0.0, 0, 90, 102.8, None),
    (0, None, 5, 0, 13.9, "Bajo"),
    (None, 5.0, 2, 10, None, None),
]


def test_churn_score_golden_rows(spark):
    df = spark.createDataFrame(
        [g[:4] for g in GOLDEN], "login long, sat double, prods long, days long"
    )
    out = df.select(
        X.churn_score("login", "sat", "prods", "days").alias("s"),
    ).withColumn("b", X.risk_band("s"))
    got = [(r.s, r.b) for r in out.collect()]
    assert got == [(g[4], g[5]) for g in GOLDEN]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5,), (50,), (500,)], "x long")
    assert [r[0] for r in df.select(X.clip_keep_null("x", 0, 90)).collect()] == [None, 0, 50, 90]


@pytest.mark.parametrize(
    "score,band",
    [(0.0, None), (0.1, "Bajo"), (30.0, "Bajo"), (30.1, "Medio"), (60.0, "Medio"), (60.1, "Alto"),
     (100.0, "Alto"), (100.1, None), (-1.0, None)],
)
def test_risk_band_edges(spark, score, band):
    assert one(spark, lambda d: X.risk_band("s"), [(score,)], "s double") == [band]


@pytest.mark.parametrize(
    "age,band,rank",
    [(17, None, None), (18, "18–25", 1), (25, "18–25", 1), (26, "26–35", 2), (35, "26–35", 2),
     (45, "36–45", 3), (55, "46–55", 4), (65, "56–65", 5), (66, "65+", 6), (120, "65+", 6), (121, None, None)],
)
def test_age_band_edges(spark, age, band, rank):
    df = spark.createDataFrame([(age,)], "a long")
    r = df.select(X.age_band("a"), X.age_band_rank("a")).first()
    assert (r[0], r[1]) == (band, rank)


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (3.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 1)).collect()][:2] == [0.2, 0.4]
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()][2:] == [2.0, 4.0]


@pytest.mark.parametrize(
    "a,p,pct",
    [(5.0, 0.0, 100.0), (0.0, 0.0, 0.0), (-3.0, 0.0, 0.0), (110.0, 100.0, 10.0), (90.0, 100.0, -10.0),
     (1.0, -4.0, 125.0), (1.0, 3.0, -66.7)],
)
def test_pct_change(spark, a, p, pct):
    assert one(spark, lambda d: X.pct_change("a", "p"), [(a, p)], "a double, p double") == [pct]


def test_change_is_good_inverted(spark):
    df = spark.createDataFrame([(5.0, False), (5.0, True), (-5.0, True), (0.0, True), (0.0, False)], "p double, inv boolean")
    assert [r[0] for r in df.select(X.change_is_good("p", F.col("inv"))).collect()] == [True, False, True, True, True]


@pytest.mark.parametrize("pct,label", [(55.0, "Crítico"), (54.9, "Alto"), (40.0, "Alto"), (25.0, "Medio"), (24.9, "Bajo")])
def test_severity(spark, pct, label):
    assert one(spark, lambda d: X.severity_band("p"), [(pct,)], "p double") == [label]


@pytest.mark.parametrize("pct,level", [(None, None), (14.0, 4), (12.0, 3), (11.9, 2), (10.0, 2), (8.0, 1), (7.9, 0)])
def test_shade(spark, pct, level):
    assert one(spark, lambda d: X.shade_level("p"), [(pct,)], "p double") == [level]


def test_score_level_and_flags(spark):
    df = spark.createDataFrame([(80.0, 5.0), (79.9, 5.1), (60.0, 1.0), (59.9, 9.0)], "s double, sat double")
    got = [(r[0], r[1], r[2]) for r in df.select(X.score_level("s"), X.low_satisfaction("sat"), X.suggestion("s")).collect()]
    assert got == [
        ("alto", True, "Contacto urgente"),
        ("medio", False, "Contacto urgente"),
        ("medio", True, "Monitoreo estándar"),
        ("bajo", False, "Monitoreo estándar"),
    ]


def test_labels(spark):
    df = spark.createDataFrame([(" churn ",), ("NO CHURN",), (None,), ("1",), ("1.0",), ("CHURN",)], "l string")
    got = df.select(X.label_score("l"), X.is_churn("l"), X.churn_status("l")).collect()
    assert [r[0] for r in got] == [95.0, 20.0, 20.0, 20.0, 20.0, 95.0]
    assert [r[1] for r in got] == [True, False, False, False, False, True]
    # exact text match only (no trim, case-sensitive)
    assert [r[2] for r in got] == ["NO CHURN", "NO CHURN", "NO CHURN", "CHURN", "CHURN", "CHURN"]


def test_month_labels(spark):
    df = spark.createDataFrame([("2025-01-01",), ("2024-12",), ("not a date",)], "m string")
    assert [r[0] for r in df.select(X.month_label_es("m")).collect()] == ["Ene 2025", "Dic 2024", "not a date"]
    df2 = spark.createDataFrame([("2026-04",), ("2025-09",)], "m string")
    assert [r[0] for r in df2.select(X.month_name_long_es("m")).collect()] == ["abril de 2026", "septiembre de 2025"]


def test_percent_and_class(spark):
    df = spark.createDataFrame([(0.29,), (0.5,), (0.499,), (0.0,)], "p double")
    got = df.select(X.truncated_percent("p"), X.predicted_class("p")).collect()
    assert [tuple(r) for r in got] == [(28, 0), (50, 1), (49, 0), (0, 0)]


def test_value_formats(spark):
    df = spark.createDataFrame([(12_345_678.0,), (1500.0,), (2500.0,), (-1500.0,)], "v double")
    got = df.select(X.money_millions("v"), X.thousands_label("v")).collect()
    assert got[0][0] == "$12.3M"
    assert [r[1] for r in got[1:]] == ["$2k", "$3k", "$-1k"]


def test_whole_days_are_24h_blocks(spark):
    df = spark.createDataFrame([("2024-01-01 23:00:00", "2024-01-02 01:00:00"), ("2024-01-01 00:00:00", "2024-01-03 00:00:00")], "a string, b string")
    df = df.select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    assert [r[0] for r in df.select(X.whole_days_between("a", "b")).collect()] == [0, 2]


def test_ratio_pct_zero_divisor(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "n long, d long")
    assert [r[0] for r in df.select(X.ratio_pct("n", "d")).collect()] == [None, 33.3]
