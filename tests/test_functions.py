"""Null, rounding, date and bucket rules on hand-sized frames."""

import datetime as dt

from pyspark.sql import functions as F

from cohortix.functions import (cut_right, div0, is_last_month_of_quarter, is_quarter_end,
                                months_between_cal, ne_or_null, quarter_end, row_sum, safe_div,
                                week_start, zsum)
from cohortix.functions.buckets import flag_label, label_map


def test_division_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0), (None, 1.0)], "a double, b double")
    r = df.select(div0("a", "b").alias("d0"), safe_div("a", "b").alias("sd")).collect()
    assert [x.d0 for x in r] == [0.0, 0.5, None]
    assert [x.sd for x in r] == [None, 0.5, None]


def test_null_sums(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(zsum("v").alias("s")).collect()}
    assert got == {1: 0, 2: 3.0}
    r = spark.createDataFrame([(None, 2.0)], "a double, b double").select(row_sum("a", "b").alias("s")).first()
    assert r.s == 2.0


def test_not_equal_treats_null_as_different(spark):
    df = spark.createDataFrame([("Churn",), (None,), ("Live",)], "s string")
    assert [r.x for r in df.select(ne_or_null("s", "Churn").alias("x")).collect()] == [False, True, True]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (0.125,), (-1.5,)], "v double")
    r = df.select(F.bround("v", 0).alias("b0"), F.bround("v", 2).alias("b2")).collect()
    assert [x.b0 for x in r] == [2.0, 0.0, -2.0]
    assert r[1].b2 == 0.12


def test_quarter_and_week_helpers(spark):
    df = spark.createDataFrame([(dt.date(2022, 6, 12),), (dt.date(2022, 3, 31),), (dt.date(2022, 2, 28),)],
                               "d date")
    r = df.select(quarter_end("d").alias("qe"), is_quarter_end("d").alias("iqe"),
                  is_last_month_of_quarter("d").alias("lm"), week_start("d").alias("ws")).collect()
    assert r[0].qe == dt.date(2022, 6, 30) and r[0].ws == dt.date(2022, 6, 6)
    assert r[1].iqe and not r[2].iqe
    assert r[0].lm and r[1].lm and not r[2].lm


def test_calendar_month_difference(spark):
    df = spark.createDataFrame([(dt.date(2022, 2, 1), dt.date(2022, 1, 31))], "a date, b date")
    assert df.select(months_between_cal("a", "b").alias("m")).first().m == 1


def test_cut_right_edges(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (-1.0,), (None,), (50.0,)], "v double")
    got = [r.t for r in df.select(cut_right("v", [0, 10, 50], ["low", "high"]).alias("t")).collect()]
    assert got == [None, "low", "high", None, None, "high"]


def test_label_helpers(spark):
    df = spark.createDataFrame([("a", True, False), ("z", True, True)], "k string, f1 boolean, f2 boolean")
    r = df.select(label_map("k", {"a": 1}, default=-1).alias("m"),
                  flag_label({"X": "f1", "Y": "f2"}).alias("lab")).collect()
    assert [x.m for x in r] == [1, -1]
    assert [x.lab for x in r] == ["X", "X+Y"]
