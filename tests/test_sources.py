"""Sources and sinks: table access, SQL path, coercion, spines, peek, sinks."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortix.functions import ilike_any
from cohortix.sources import (Tables, coerce_types, day_spine, hour_spine, month_spine, period_table,
                              query_to_table, random_peek, save_table, write_bundle, write_csv)

from .conftest import SF001


def test_tables_and_sql_path(spark):
    t = Tables(spark, SF001)
    assert t("nation") is t("nation")            # one lazy frame per table
    t.register("nation")
    df = query_to_table(spark, "SELECT n_regionkey, count(*) FROM nation GROUP BY 1", ["region", "n"])
    assert df.columns == ["region", "n"] and df.count() == 5


def test_coerce_types(spark):
    df = spark.createDataFrame([("1.5", "2020-01-02", "x"), ("2", "2021-03-04", "1")], "a string, b string, c string")
    out = coerce_types(df)
    assert dict(out.dtypes) == {"a": "double", "b": "date", "c": "string"}


def test_spines(spark):
    assert month_spine(spark, "2020-01-15", "2020-04-01").count() == 4
    assert day_spine(spark, "2020-02-27", "2020-03-01").count() == 4
    hs = hour_spine(spark, "2024-01-01", "2024-01-02").collect()
    assert len(hs) == 48 and hs[0].hour == dt.datetime(2024, 1, 1, 0, 0)
    p = period_table(spark, month_spine(spark, "2020-01-01", "2020-01-01"), (30, 60))
    rows = {(r.period_type, r.daysinperiod): (r.period_start, r.period_end) for r in p.collect()}
    assert rows[("backward", 30)] == (dt.date(2019, 12, 2), dt.date(2020, 1, 1))
    assert rows[("forward", 60)] == (dt.date(2020, 1, 1), dt.date(2020, 3, 1))


def test_random_peek_and_ilike(spark):
    df = spark.range(1000)
    a = random_peek(df, 3, seed=5).collect()
    assert len(a) == 3 and a == random_peek(df, 3, seed=5).collect()
    names = spark.createDataFrame([("Gift Card Program",), ("Loyalty",), ("other",)], "m string")
    assert names.filter(ilike_any("m", ["gift card%", "%LOYALTY%"])).count() == 2


def test_sinks(spark):
    root = tempfile.mkdtemp(prefix="cohortix-sink-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    write_csv(df, os.path.join(root, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(root, "csv")).count() == 2
    paths = write_bundle({"one": df, "two": df.filter(F.col("k") > 1)}, os.path.join(root, "bundle"))
    assert [spark.read.parquet(p).count() for p in paths] == [2, 1]
    save_table(df, "unused", path=os.path.join(root, "table"), partition_by=["v"])
    assert spark.read.parquet(os.path.join(root, "table")).count() == 2


def test_bundle_appears_whole_or_not_at_all(spark, tmp_path):
    from cohortix.sources import Bundle
    folder = str(tmp_path / "bundle")
    bundle = Bundle(spark, folder)
    assert bundle.manifest() is None
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    first = bundle.commit({"a": a, "b": a.filter("k > 1"), "none": a.filter("k > 5")})
    assert first["rows"] == {"a": 2, "b": 1, "none": 0}
    assert bundle.read("a").count() == 2 and bundle.read("none").columns == ["k", "v"]
    broken = a.select("k", F.raise_error(F.lit("no such value")).cast("string").alias("v"))
    with pytest.raises(Exception, match="no such value"):
        bundle.commit({"a": a.filter("k = 1"), "b": broken})
    # readers see the bundle as it was, and no part of the failed one is left
    assert bundle.manifest() == first and bundle.read("a").count() == 2
    assert [n for n in os.listdir(folder) if n.startswith("data-")] == [first["data"]]
    second = bundle.commit({"a": a.filter("k = 1")})
    assert bundle.read("a").count() == 1 and second["previous"] == first["data"]
    with pytest.raises(KeyError):
        bundle.read("b")
    third = bundle.commit({"a": a}, fmt="csv")
    assert sorted(n for n in os.listdir(folder) if n.startswith("data-")) == sorted([second["data"], third["data"]])
    assert bundle.read("a").count() == 2
    for bad in ("", "x/y", "_hidden"):
        with pytest.raises(ValueError):
            bundle.commit({bad: a})


def test_shared_folder_follows_the_session(spark):
    from types import SimpleNamespace as NS

    from cohortix.sources import new_folder, shared_root

    def session(master, folder):
        return NS(conf=NS(get=lambda k, d: d), sparkContext=NS(master=master, getConf=lambda: NS(get=lambda k, d: folder)))
    assert shared_root(session("yarn", "hdfs://h/shared/")) == "hdfs://h/shared"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_root(session(master, None))
    assert shared_root(session("local[2]", None)).startswith("file://")
    a, b = new_folder(spark, "t"), new_folder(spark, "t")
    assert a != b and a.startswith(shared_root(spark) + "/t-")
