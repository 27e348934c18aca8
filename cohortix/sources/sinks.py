"""Sinks: CSV, a bundle of named tables (one folder per sheet), saved tables,
tables kept by month, and bundles whose outputs appear together."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_bundle(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> list[str]:
    """Write every DataFrame to ``folder/<name>`` (the workbook-with-sheets
    replacement).  Returns the written paths."""
    paths = []
    for name, df in tables.items():
        p = os.path.join(folder, name)
        w = df.write.mode(mode)
        (w.option("header", True).csv(p) if fmt == "csv" else w.format(fmt).save(p))
        paths.append(p)
    return paths


def save_table(df: DataFrame, name: str, path: str | None = None,
               partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Create-or-replace a table as select.  With ``path`` the table is
    written as parquet there (no catalog needed)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w.parquet(path)
    else:
        w.saveAsTable(name)


class MonthTable:
    """A Parquet table with a folder per month of its date column.

    ``create`` writes it anew, ``replace`` rewrites only the months it is given
    (dynamic partition overwrite: the files of other months stay as they are),
    ``read`` lists and opens the folders of the wanted months only.  Rows are dealt
    by month and rebalanced before the write: a month's rows come in files of the
    advisory size, and a month that holds a third of all rows is split over tasks."""

    PART = "month_part"

    def __init__(self, spark: SparkSession, path: str, date_col: str = "dt"):
        self.spark, self.path, self.date_col = spark, path.rstrip("/"), date_col

    def _write(self, df: DataFrame, dynamic: bool) -> None:
        if self.PART in df.columns:
            raise ValueError(f"the table's own partition column is called {self.PART}")
        rows = df.withColumn(self.PART, F.trunc(self.date_col, "month")).hint("rebalance", self.PART)
        w = rows.write.mode("overwrite").partitionBy(self.PART)
        if dynamic:
            w = w.option("partitionOverwriteMode", "dynamic")
        w.parquet(self.path)

    def create(self, df: DataFrame) -> None:
        """The whole table anew.  Rows without a date get a partition of their own."""
        self._write(df, dynamic=False)

    def replace(self, df: DataFrame, months: list[str]) -> None:
        """Rows of ``months`` (first days, yyyy-MM-01) instead of what stands there.
        A month without rows in ``df`` becomes empty; rows of other months are an
        error, as they would replace their month by a part of it.  ``df`` is
        evaluated once."""
        wanted = sorted({dt.date.fromisoformat(m) for m in months})
        if any(m.day != 1 for m in wanted):
            raise ValueError("a month is named by its first day")
        month, kind = F.trunc(self.date_col, "month"), df.schema[self.date_col].dataType
        stray = F.raise_error(F.concat(F.lit("a row outside the replaced months: "), F.coalesce(F.col(self.date_col).cast("string"), F.lit("null"))))
        inside = F.coalesce(month.isin(*wanted), F.lit(False))
        old = {m: self._files(m) for m in wanted}
        self._write(df.withColumn(self.date_col, F.when(inside, F.col(self.date_col)).otherwise(stray.cast(kind))), dynamic=True)
        for m in wanted:
            if old[m] and old[m] <= self._files(m):     # no rows came in place of the old ones
                self._folder(m, lambda fs, path: fs.delete(path, True))

    def _folder(self, month: dt.date, use):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.PART}={month}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return use(fs, path) if fs.exists(path) else None

    def _files(self, month: dt.date) -> set[str]:
        return set(self._folder(month, lambda fs, path: [f.getPath().getName() for f in fs.listStatus(path)]) or [])

    def read(self, first: str | None = None, last: str | None = None, months: list[str] | None = None,
             schema: T.StructType | None = None) -> DataFrame:
        """The rows, with the month as a column; ``first``/``last`` bound the months
        (both included) and prune folders before any file is opened."""
        r = self.spark.read
        df = (r.schema(schema) if schema is not None else r).parquet(self.path)
        df = df.withColumn(self.PART, F.col(self.PART).cast("date"))
        if first:
            df = df.filter(F.col(self.PART) >= F.lit(first).cast("date"))
        if last:
            df = df.filter(F.col(self.PART) <= F.lit(last).cast("date"))
        if months is not None:
            df = df.filter(F.col(self.PART).isin(*[dt.date.fromisoformat(m) for m in months]))
        return df


class Bundle:
    """Several outputs that readers see together or not at all.

    Outputs are written below a new data folder that no reader knows; the manifest,
    written last and moved into place by one rename, names that folder, the outputs
    and their row counts.  A write that fails leaves the manifest, and so the bundle,
    as it was, and takes its own data folder away.  The folder of the bundle before
    the last one is removed after a commit: readers of the last one keep theirs."""

    MANIFEST = "_manifest.json"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """The manifest of the last commit; None before the first one."""
        path, fs = self._path(self.MANIFEST), self._fs()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, outputs: dict[str, DataFrame], fmt: str = "parquet") -> dict:
        data = f"data-{uuid.uuid4().hex[:12]}"
        before = self.manifest()
        rows = {}
        try:
            for name, df in outputs.items():
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"no name for an output: {name!r}")
                where = f"{self.folder}/{data}/{name}"
                # the rows that the writing job has seen, counted while it writes
                seen = Observation(name)
                w = df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("header", True)
                w.format(fmt).save(where)
                rows[name] = seen.get.get("n", 0)
        except Exception:
            self._fs().delete(self._path(data), True)
            raise
        m = {"data": data, "format": fmt, "rows": rows, "previous": before["data"] if before else None}
        self._put(m)
        if before and before["previous"]:
            self._fs().delete(self._path(before["previous"]), True)
        return m

    def _put(self, manifest: dict) -> None:
        new = self._path(f"_new-{uuid.uuid4().hex[:12]}.json")
        stream = self._fs().create(new, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path("x").toUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(over, 1)
        options[0] = over.OVERWRITE
        context.rename(new, self._path(self.MANIFEST), options)

    def read(self, name: str) -> DataFrame:
        m = self.manifest()
        if m is None or name not in m["rows"]:
            raise KeyError(f"no output {name!r} in the bundle")
        return self.spark.read.option("header", True).format(m["format"]).load(f"{self.folder}/{m['data']}/{name}")
