"""SQL-to-table helpers (warehouse query replacements).

* ``query_to_table``: run SQL; optional positional column names.
* ``coerce_types``  : per string column try double, then date, else keep the
  string -- decided by one aggregate over all columns (a cast is kept only if
  it turns no non-null value into null).
* ``use_database``  : select the current catalog namespace.
* ``random_peek``   : a seeded random sample of ``n`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def query_to_table(spark: SparkSession, sql: str, columns: list[str] | None = None,
                   args: dict | None = None) -> DataFrame:
    df = spark.sql(sql, args=args) if args else spark.sql(sql)
    return df.toDF(*columns) if columns else df


def random_peek(df: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """``n`` random rows (sampling operator): ordering by a seeded random key
    under a limit plans as TakeOrderedAndProject -- each partition keeps its
    best ``n`` rows, no full sort."""
    return df.orderBy(F.rand(seed)).limit(n)


def use_database(spark: SparkSession, database: str) -> None:
    spark.catalog.setCurrentDatabase(database)


def coerce_types(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not strings:
        return df
    checks = []
    for c in strings:
        v = F.col(c)
        checks.append(F.sum(F.when(v.isNotNull() & v.try_cast("double").isNull(), 1)
                            .otherwise(0)).alias(f"d_{c}"))
        checks.append(F.sum(F.when(v.isNotNull() & F.try_to_date(v).isNull(), 1)
                            .otherwise(0)).alias(f"t_{c}"))
    bad = df.agg(*checks).first().asDict()  # one row: two counters per column
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in strings and bad[f"d_{c}"] == 0:
            out.append(F.col(c).try_cast("double").alias(c))
        elif c in strings and bad[f"t_{c}"] == 0:
            out.append(F.try_to_date(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
