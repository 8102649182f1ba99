"""Customer purchase behaviour.

All operators start from ``purchases_per_customer`` or an equivalent
per-customer aggregate: a partially aggregated shuffle on customer_id, so a
customer holding a third of all rows costs one row per map task, not one
task sorting a third of the data.  Rows without a customer id belong to no
customer and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiller.functions.columns import month_start, share_pct, with_share_of_total
from tiller.functions.labels import CUSTOMER_SEGMENTS, PURCHASE_FREQUENCY_K

# Purchases of one day that a row stands for while they are spread.
DAY_BLOCK = 1024


def purchases_per_customer(tx: DataFrame, customer: str = "customer_id") -> DataFrame:
    """(customer_id, purchases)."""
    return (tx.where(F.col(customer).isNotNull())
            .groupBy(F.col(customer).alias("customer_id"))
            .agg(F.count(F.lit(1)).alias("purchases")))


def purchase_frequency(tx: DataFrame, k: int = PURCHASE_FREQUENCY_K,
                       customer: str = "customer_id") -> DataFrame:
    """Customers per number of purchases, first ``k`` counts.

    (num_purchases, num_customers, pct) with pct over all customers,
    ordered by num_purchases ascending.
    """
    per = purchases_per_customer(tx, customer)
    freq = per.groupBy(F.col("purchases").alias("num_purchases")).agg(
        F.count(F.lit(1)).alias("num_customers"))
    freq = with_share_of_total(freq, "num_customers")
    return freq.orderBy("num_purchases").limit(k)


def _segment(purchases) -> tuple:
    label = None
    name = None
    order = None
    for i, (lab, lo, hi, nm) in enumerate(CUSTOMER_SEGMENTS, start=1):
        cond = purchases >= lo if hi is None else purchases.between(lo, hi)
        label = F.when(cond, F.lit(lab)) if label is None else label.when(cond, F.lit(lab))
        name = F.when(cond, F.lit(nm)) if name is None else name.when(cond, F.lit(nm))
        order = F.when(cond, F.lit(i)) if order is None else order.when(cond, F.lit(i))
    return order, label, name


def customer_segments(tx: DataFrame, customer: str = "customer_id") -> DataFrame:
    """(segment_order, segment, segment_name, customers, pct)."""
    per = purchases_per_customer(tx, customer)
    order, label, name = _segment(F.col("purchases"))
    seg = (per.select(order.alias("segment_order"), label.alias("segment"),
                      name.alias("segment_name"))
           .groupBy("segment_order", "segment", "segment_name")
           .agg(F.count(F.lit(1)).alias("customers")))
    return with_share_of_total(seg, "customers").orderBy("segment_order")


def new_customer_share(tx: DataFrame, customer: str = "customer_id") -> DataFrame:
    """(customers, new_customers, new_customer_pct) - one purchase only."""
    per = purchases_per_customer(tx, customer)
    return per.agg(F.count(F.lit(1)).alias("customers"),
                   F.count_if(F.col("purchases") == 1).alias("new_customers")) \
        .withColumn("new_customer_pct", F.coalesce(
            share_pct("new_customers", "customers"), F.lit(0.0)))


def segment_rate(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """Purchases per customer and month, by segment.

    (segment_order, segment, customers, purchases, months,
    purchases_per_customer_month) where months = distinct months with data.
    """
    # one row per customer, with its months (bounded by the calendar); the rows
    # without a customer only add their months
    per = (tx.groupBy(F.col(customer).alias("_customer"))
           .agg(F.count(F.lit(1)).alias("purchases"),
                F.collect_set(month_start(date)).alias("_months")))
    order, label, _ = _segment(F.when(F.col("_customer").isNotNull(), F.col("purchases")))
    each = per.select(order.alias("segment_order"), label.alias("segment"), "purchases",
                      F.posexplode_outer("_months").alias("_nth", "_month"))
    first = F.coalesce(F.col("_nth"), F.lit(0)) == 0
    seg = (each.groupBy("segment_order", "segment")
           .agg(F.count_if(first).alias("customers"),
                F.sum(F.when(first, F.col("purchases"))).cast("bigint").alias("purchases"),
                F.collect_set("_month").alias("_months")))
    # a handful of rows: the segments
    months = F.array_distinct(F.flatten(F.collect_list("_months").over(Window.partitionBy())))
    seg = (seg.withColumn("months", F.size(months).cast("bigint"))
           .where(F.col("segment").isNotNull()))
    rate = F.try_divide(F.col("purchases").cast("double"),
                        F.col("customers").cast("double") * F.col("months").cast("double"))
    return seg.select("segment_order", "segment", "customers", "purchases", "months",
                      rate.alias("purchases_per_customer_month")).orderBy("segment_order")


def top_customer(tx: DataFrame, customer: str = "customer_id") -> DataFrame:
    """A13 for customers: (customer_id, purchases) of the most frequent
    customer (ties: smallest id).  A global min over structs - no sort."""
    per = purchases_per_customer(tx, customer)
    m = per.agg(F.min(F.struct((-F.col("purchases")).alias("neg"),
                               F.col("customer_id").alias("id"))).alias("m"))
    return m.where(F.col("m").isNotNull()).select(
        F.col("m.id").alias("customer_id"), (-F.col("m.neg")).alias("purchases"))


def customer_gaps(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """W1 per customer: (customer_id, purchases, mean_gap_days).

    The mean of the day gaps between consecutive purchases (ordered by
    date, same-day repeats giving 0) telescopes to
    (last date - first date) / (dated purchases - 1), so it is an ordinary
    aggregate: no per-customer sort, safe for customers of any size.
    NULL for customers with fewer than two dated purchases.
    """
    d = F.col(date)
    g = (tx.where(F.col(customer).isNotNull())
         .groupBy(F.col(customer).alias("customer_id"))
         .agg(F.count(F.lit(1)).alias("purchases"), F.count(d).alias("_dated"),
              F.min(d).alias("_first"), F.max(d).alias("_last")))
    gap = F.when(F.col("_dated") > 1,
                 F.datediff(F.col("_last"), F.col("_first")).cast("double")
                 / (F.col("_dated") - 1).cast("double"))
    return g.select("customer_id", "purchases", gap.alias("mean_gap_days"))


def purchase_days(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """W1, a row for each day on which a customer buys.

    (customer_id, date, purchases, prev_date, gap_days): the purchases of that day,
    the customer's previous day with one and the days between; NULL for the first.

    The scan over a customer's purchases is cut into segments, its days: inside a
    day every purchase but the first follows another one of that day, so a
    partially aggregated count says all of it, and only the last date of the
    segment before is carried over.  The window spans the days of a customer - at
    most those of the calendar, however many rows the customer holds.
    Rows without a customer or a date have no previous purchase and are left out.
    """
    days = (tx.where(F.col(customer).isNotNull() & F.col(date).isNotNull())
            .groupBy(F.col(customer).alias("customer_id"), F.col(date).alias("date"))
            .agg(F.count(F.lit(1)).alias("purchases")))
    before = F.lag("date").over(Window.partitionBy("customer_id").orderBy("date"))
    return (days.withColumn("prev_date", before)
            .withColumn("gap_days", F.datediff("date", "prev_date")))


def previous_purchase(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """(customer_id, date, prev_date, gap_days), a row for each purchase.

    ``prev_date`` is the date of the customer's purchase before it in date order
    (NULL for the first one); further purchases of a day follow one of the same
    day, with gap 0.  The rows of a day come back from ``purchase_days`` in two
    steps, blocks of ``DAY_BLOCK`` purchases that are spread over the tasks, then
    the purchases of a block, so a day that holds a third of all rows is split.
    """
    days = purchase_days(tx, customer, date)
    last_block = F.floor((F.col("purchases") - 1) / DAY_BLOCK)
    parts = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (days.withColumn("_block", F.explode(F.sequence(F.lit(0), last_block)))
              .repartition(parts, "customer_id", "date", "_block"))
    size = F.least(F.lit(DAY_BLOCK), F.col("purchases") - F.col("_block") * DAY_BLOCK)
    each = blocks.withColumn("_nth", F.explode(F.sequence(F.lit(1), size.cast("int"))))
    first = (F.col("_block") == 0) & (F.col("_nth") == 1)
    return each.select("customer_id", "date",
                       F.when(first, F.col("prev_date")).otherwise(F.col("date")).alias("prev_date"),
                       F.when(first, F.col("gap_days")).otherwise(F.lit(0)).alias("gap_days"))


def inter_purchase_days(tx: DataFrame, customer: str = "customer_id",
                        date: str = "date") -> DataFrame:
    """Mean over customers of each customer's mean gap in days.

    (customers_with_gap, avg_days_between_purchases); customers with a single
    purchase drop out (unweighted macro mean).
    """
    g = customer_gaps(tx, customer, date)
    return g.agg(F.count("mean_gap_days").alias("customers_with_gap"),
                 F.avg("mean_gap_days").alias("avg_days_between_purchases"))
