"""Validity intervals and their reading at quarter ends."""

import datetime as dt

from cohortix.operators.intervals import at_quarter_ends, validity
from pyspark.sql import functions as F

D = dt.date
SCHEMA = "k string, d date, state string, until date"


def frame(spark):
    return spark.createDataFrame([
        ("a", D(2020, 1, 10), "x", None), ("a", D(2020, 2, 1), "x", None), ("a", D(2020, 5, 1), "y", D(2020, 6, 1)), ("a", D(2020, 9, 30), None, None),
        ("b", D(2020, 3, 31), "x", D(2020, 3, 31)), ("c", D(2020, 3, 31), "x", D(2020, 4, 1)), (None, D(2020, 12, 31), "z", None)], SCHEMA)


def test_intervals_join_equal_neighbours(spark):
    got = sorted((tuple(r) for r in validity(frame(spark), ["k"], "d", ["state"], F.col("until")).collect()), key=str)
    assert got == sorted([
        ("a", "x", D(2020, 1, 10), D(2020, 5, 1)),         # two equal rows are one interval
        ("a", "y", D(2020, 5, 1), D(2020, 6, 1)),          # cut by its own end; nothing stands in between
        ("a", None, D(2020, 9, 30), None), ("c", "x", D(2020, 3, 31), D(2020, 4, 1)), (None, "z", D(2020, 12, 31), None)], key=str)


def test_quarter_ends_inside_intervals(spark):
    iv = validity(frame(spark), ["k"], "d", ["state"], F.col("until"))
    got = {(r.k, r.state, r.dt) for r in at_quarter_ends(iv, "2020-12-31").collect()}
    # b's interval has no day; c holds on the quarter's last day only; a row of the
    # last day counts for that quarter
    assert got == {("a", "x", D(2020, 3, 31)), ("a", None, D(2020, 9, 30)), ("a", None, D(2020, 12, 31)), ("c", "x", D(2020, 3, 31)),
                   (None, "z", D(2020, 12, 31))}
    assert {r.dt for r in at_quarter_ends(iv, "2020-12-30").collect()} == {D(2020, 3, 31), D(2020, 9, 30)}
    assert {r.dt for r in at_quarter_ends(iv, "2020-12-31", since="2020-08-01").collect()} == {D(2020, 9, 30), D(2020, 12, 31)}


def test_states_between_equal_ends_do_not_merge_over_a_gap(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), "x", D(2020, 2, 1)), ("a", D(2020, 3, 1), "x", D(2020, 4, 1))], SCHEMA)
    assert validity(df, ["k"], "d", ["state"], F.col("until")).count() == 2
