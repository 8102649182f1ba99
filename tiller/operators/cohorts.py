"""Monthly cohorts and retention.

Plan: one partially aggregated shuffle by customer gathers each customer's
distinct months - at most one per month of the calendar, whatever the
customer's volume.  The cohort is the earliest of them; activity counts, cohort
sizes and retention are aggregates and windows over the (cohort, index) grid.
No self-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiller.functions.columns import month_start, months_apart

#: Months whose activity a long holds.
ERA_MONTHS = 60


def with_cohort(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """(customer_id, month, cohort_month, cohort_index), one row per
    customer and month, for rows with both keys (M10)."""
    months = (tx.where(F.col(customer).isNotNull() & F.col(date).isNotNull())
              .groupBy(F.col(customer).alias("customer_id"))
              .agg(F.collect_set(month_start(date)).alias("_months")))
    return (months.select("customer_id", F.explode("_months").alias("month"),
                          F.array_min("_months").alias("cohort_month"))
            .withColumn("cohort_index", months_apart(F.col("month"), F.col("cohort_month"))))


def cohort_state(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """(customer_id, era, months): a customer's active months as bits of a long.

    An era is ``ERA_MONTHS`` months, counted from January of the year 1; bit i of
    ``months`` is its i-th month.  Partially aggregated, so a hot customer sends a
    row per task and era.  Rows without a customer or a date are in no state.
    """
    number = F.year(F.col(date)) * 12 + F.month(F.col(date)) - 13
    return (tx.where(F.col(customer).isNotNull() & F.col(date).isNotNull())
            .select(F.col(customer).alias("customer_id"), number.alias("_number"))
            .groupBy("customer_id", F.floor(F.col("_number") / ERA_MONTHS).cast("int").alias("era"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, pmod(_number, {ERA_MONTHS}))")).alias("months")))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several, of old files and new ones; files read twice change nothing."""
    return (reduce(DataFrame.unionByName, states).groupBy("customer_id", "era")
            .agg(F.bit_or("months").alias("months")))


def cohorts_of_state(state: DataFrame) -> DataFrame:
    """``with_cohort``'s rows (customer_id, month, cohort_month, cohort_index), from a state."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(ERA_MONTHS - 1)),
                    lambda i: F.getbit(F.col("months"), i) == 1)
    numbers = state.select("customer_id", F.transform(
        bits, lambda i: F.col("era") * ERA_MONTHS + i).alias("_numbers"))
    # the eras of one customer: at most the calendar
    all_of = numbers.groupBy("customer_id").agg(F.flatten(F.collect_list("_numbers")).alias("_all"))
    start = F.lit("0001-01-01").cast("date")
    return all_of.select("customer_id", F.explode("_all").alias("_at"),
                         F.array_min("_all").alias("_first")).select(
        "customer_id", F.add_months(start, F.col("_at")).alias("month"),
        F.add_months(start, F.col("_first")).alias("cohort_month"),
        (F.col("_at") - F.col("_first")).alias("cohort_index"))


def cohort_activity(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """(cohort_month, cohort_index, active_customers)."""
    return _activity(with_cohort(tx, customer, date))


def _activity(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("cohort_month", "cohort_index")
            .agg(F.count(F.lit(1)).alias("active_customers")))


def cohort_sizes(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """(cohort_month, cohort_size) - customers whose first month it is."""
    return (cohort_activity(tx, customer, date)
            .where(F.col("cohort_index") == 0)
            .select("cohort_month", F.col("active_customers").alias("cohort_size"))
            .orderBy("cohort_month"))


def _retention(tx: DataFrame, customer: str, date: str) -> DataFrame:
    return _rates(cohort_activity(tx, customer, date))


def _rates(act: DataFrame) -> DataFrame:
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month"))
    return (act.withColumn("cohort_size", size)
            .withColumn("retention_rate",
                        F.try_divide(F.col("active_customers").cast("double"),
                                     F.col("cohort_size").cast("double"))))


def retention(tx: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """A24 + J3: (cohort_month, cohort_index, active_customers, cohort_size,
    retention_rate).  The cohort size reaches every index through a window
    over the cohort's grid row, not a join."""
    return _retention(tx, customer, date).orderBy("cohort_month", "cohort_index")


def retention_of_state(state: DataFrame) -> DataFrame:
    """``retention`` from a state: the same rows, without the transactions."""
    return _rates(_activity(cohorts_of_state(state))).orderBy("cohort_month", "cohort_index")


def retention_matrix(tx: DataFrame, customer: str = "customer_id", date: str = "date",
                     indices: list[int] | None = None) -> DataFrame:
    """Cohort x index pivot of the retention rate (mean per cell).

    Columns: cohort_month, then one column per cohort index named by the index.
    Without ``indices`` they run from 0 to the months between the first and the
    last month of the data, which one min/max aggregate (a job) finds, so no cell
    can be missing.  With ``indices``, a cell outside them is an error when the
    plan runs.
    """
    if indices is None:
        ends = tx.where(F.col(customer).isNotNull() & F.col(date).isNotNull()).agg(
            months_apart(month_start(F.max(date)), month_start(F.min(date))).alias("n")).first()
        indices = list(range((-1 if ends["n"] is None else ends["n"]) + 1))
    index = F.col("cohort_index")
    inside = index.isin(indices) if indices else F.lit(False)
    r = _retention(tx, customer, date).withColumn("cohort_index", F.when(inside, index).otherwise(
        F.raise_error(F.concat(F.lit("cohort index not listed: "), index.cast("string"))).cast("int")))
    return (r.groupBy("cohort_month").pivot("cohort_index", indices)
            .agg(F.avg("retention_rate")).orderBy("cohort_month")) if indices else \
        r.select("cohort_month").distinct()
