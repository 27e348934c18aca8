"""Connected components of an edge table, by large-star and small-star rounds.

Each round keeps the components and shortens the paths; it ends when every
node points at its component's smallest node.  Rounds are written to the shared
folder, so lineage stays short and a lost executor costs one round.  Hot nodes
are pre-aggregated (minimum per node) and their joins split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import discard, written


def _oriented(e: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller one."""
    return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _signature(e: DataFrame):
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns u, v; null ends
    are no edge); component is the smallest node.  No edges, no rows."""
    e = written(_oriented(edges.filter("u is not null and v is not null").select("u", "v")), "components")
    before = _signature(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _oriented(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        done = e
        e = written(_oriented(small), "components")
        after = _signature(e)
        discard(done)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
