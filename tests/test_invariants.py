"""SURVEY 5 invariants on the fixture tables (sf0.01)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from cohortix import catalog as C
from cohortix.operators.joins import hour_split
from cohortix.sources import fixtures as fx
from cohortix.sources.tables import Tables

from .conftest import SF01


def test_gross_retention_never_exceeds_net(spark):
    q = E.queries()
    net = {r.month: r for r in q["m14_net_retention"](spark, SF01).collect()}
    gross = {r.month: r for r in q["m14_gross_retention"](spark, SF01).collect()}
    for m, g in gross.items():
        assert g.live_pos_saas_12 <= net[m].live_pos_saas_12 + 1e-6
        assert g.gmv_12 <= net[m].gmv_12 + 1e-6


def test_proration_sums_back_to_parent(spark):
    t = Tables(spark, SF01)
    p = C._prorated(t)
    sums = p.groupBy("parent_id", "month").agg(F.sum("ec_saas_arr").alias("s"), F.max("live_locations").alias("n"))
    pm = C._parent_month(t).select("parent_id", "month", "ec_saas_arr")
    bad = (sums.join(pm, ["parent_id", "month"]).filter(F.col("n") > 0)
               .filter(F.abs(F.col("s") - F.col("ec_saas_arr")) > 1e-6 * (1 + F.abs("ec_saas_arr"))).count())
    assert bad == 0


def test_occupancy_pieces_sum_to_interval(spark):
    states = fx.agent_state_log(Tables(spark, SF01))
    pieces = hour_split(states.withColumn("id", F.monotonically_increasing_id()), "start_ts", "seconds")
    bad = (pieces.groupBy("id").agg(F.sum("seconds_in_hour").alias("s"), F.first("seconds").alias("secs"))
                 .filter(F.col("s") != F.col("secs")).count())
    assert bad == 0


def test_location_shares_sum_to_100(spark):
    b = E.queries()["m35_booking_cohort"](spark, SF01)
    for r in b.groupBy("close_quarter").agg(F.sum("percent_of_locations").alias("p")).collect():
        assert abs(r.p - 100) < 0.05
