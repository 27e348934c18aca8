"""Churn by processor by month.

Reference shape: months x customers (full outer join without a condition),
vendor of the month = last vendor row of the month, else the previous
non-null month's, else the next one's; keep months from the first-order month
to the churn month; six distinct counts per month.

Spark plan: no cross join.  Each customer's kept month range is generated
with ``sequence``; months outside it enter only when they carry a vendor
(that is all the previous/next non-null fill can see there).  The fill runs
on the customer-month grain (one row per month per customer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import month_start
from ..operators.windows import nearest_non_null


def processor_churn(customers: DataFrame, vendor_events: DataFrame, payments: DataFrame,
                    start: str, end: str, vendors: dict[str, str]) -> DataFrame:
    """customers: customer_id, first_order_date, churn_date
    vendor_events: customer_id, dt, seq, vendor (later (dt, seq) wins)
    payments: customer_id, month, gmv
    vendors: output label -> vendor value."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    c = customers.select(
        "customer_id",
        month_start("first_order_date").alias("pfom"),
        month_start(F.coalesce("churn_date", F.lit("2099-12-31").cast("date"))).alias("churn"))
    lo_all, hi_all = F.trunc(s, "month"), F.trunc(e, "month")
    # months inside each customer's kept window [first order, churn] ...
    trim = (c.filter(F.col("pfom").isNotNull())
             .withColumn("lo", F.greatest("pfom", lo_all)).withColumn("hi", F.least("churn", hi_all))
             .filter(F.col("lo") <= F.col("hi"))
             .select("customer_id", "pfom", "churn",
                     F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"),
                     F.lit(True).alias("kept")))
    # ... plus the months that carry a vendor anywhere in [start, end]: the
    # fill may reach outside the kept window, but only to such months
    vm = (vendor_events.groupBy("customer_id", month_start("dt").alias("month"))
          .agg(F.max_by("vendor", F.struct("dt", "seq")).alias("vendor"))
          .filter(F.col("month").between(lo_all, hi_all)))
    pm = payments.select("customer_id", "month", F.coalesce("gmv", F.lit(0.0)).alias("gmv_adj"))
    d = trim.join(vm, ["customer_id", "month"], "full")
    d = nearest_non_null(d, ["customer_id"], "month", "vendor", "month_vendor")
    d = d.filter(F.col("kept")).join(pm, ["customer_id", "month"], "left")
    aggs = []
    for label, v in vendors.items():
        isv = F.col("month_vendor") == v
        aggs += [F.count_if(isv).alias(label),
                 F.count_if(isv & (F.col("gmv_adj") > 0)).alias(f"{label}_active"),
                 F.count_if(isv & (F.col("churn") == F.col("month"))).alias(f"{label}_churn")]
    # (customer, month) is unique here, so count_if == count(distinct customer)
    return d.groupBy(F.date_format("month", "yyyy-MM").alias("yr_mo")).agg(*aggs)
