"""Distributions over months, weekdays and stores (A17-A19, A26, A30,
W3, W4, W6).

Each operator is one partially aggregated shuffle on a low-cardinality key
(month, weekday, store); shares, ranks and gaps are windows over the
aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiller.functions.columns import month_start, share_pct, weekday_label, with_share_of_total


def date_range(tx: DataFrame, date: str = "date") -> DataFrame:
    """(min_date, max_date) - one partial aggregate, no shuffle of rows."""
    return tx.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def monthly_distribution(tx: DataFrame, date: str = "date") -> DataFrame:
    """(year, month, transactions, pct) ordered by year, month."""
    d = F.col(date)
    agg = (tx.groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
           .agg(F.count(F.lit(1)).alias("transactions")))
    return with_share_of_total(agg, "transactions").orderBy("year", "month")


def monthly_series(tx: DataFrame, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Transactions per month start (and per ``by`` keys).

    (*by, month, transactions); rows without a date carry no month and are
    left out of the series.
    """
    m = month_start(date).alias("month")
    return (tx.where(F.col(date).isNotNull())
            .groupBy(*by, m).agg(F.count(F.lit(1)).alias("transactions")))


def total_series(series: DataFrame, month: str = "month",
                 value: str = "transactions") -> DataFrame:
    """The chain-wide series from per-store series: (month, value).

    Per-store counts add up to the chain's, so the global series is a small
    aggregate of an already aggregated frame instead of a second pass over
    the transactions.
    """
    return series.groupBy(month).agg(F.sum(value).cast("bigint").alias(value))


def series_with_total(series: DataFrame, key: str = "store_id", total: str = "global",
                      month: str = "month", value: str = "transactions") -> DataFrame:
    """(series, month, value): every key's series, named by the key, and their
    total, in one pass over the aggregated rows."""
    names = F.explode(F.array(F.lit(total), F.col(key).cast("string"))).alias("series")
    return (series.select(names, month, value).groupBy("series", month)
            .agg(F.sum(value).cast("bigint").alias(value)))


def monthly_growth(tx: DataFrame, date: str = "date") -> DataFrame:
    """Month-over-month growth and growth since the first month.

    (month, transactions, growth_pct, growth_from_first_pct); growth_pct is
    NULL for the first month.
    """
    s = monthly_series(tx, date)
    w = Window.orderBy("month")
    first = F.first("transactions").over(w.rowsBetween(Window.unboundedPreceding,
                                                       Window.unboundedFollowing))
    prev = F.lag("transactions").over(w)
    return (s.withColumn("_prev", prev)
            .withColumn("_first", first)
            .withColumn("growth_pct",
                        share_pct(F.col("transactions") - F.col("_prev"), F.col("_prev")))
            .withColumn("growth_from_first_pct",
                        share_pct(F.col("transactions") - F.col("_first"), F.col("_first")))
            .drop("_prev", "_first"))


def _weekdays(tx: DataFrame, date: str) -> DataFrame:
    agg = (tx.groupBy(F.dayofweek(F.col(date)).alias("day_of_week"))
           .agg(F.count(F.lit(1)).alias("transactions")))
    agg = with_share_of_total(agg, "transactions")
    return agg.select("day_of_week", weekday_label("day_of_week").alias("day_name"),
                      "transactions", "pct")


def weekday_distribution(tx: DataFrame, date: str = "date") -> DataFrame:
    """(day_of_week, day_name, transactions, pct), Sunday (1) first."""
    return _weekdays(tx, date).orderBy(F.asc_nulls_last("day_of_week"))


def weekday_ranking(tx: DataFrame, date: str = "date") -> DataFrame:
    """W4 for weekdays: (rank, day_of_week, day_name, transactions)."""
    d = _weekdays(tx, date)
    w = Window.orderBy(F.desc("transactions"))
    return d.select(F.rank().over(w).alias("rank"), "day_of_week", "day_name", "transactions")


def weekend_share(tx: DataFrame, date: str = "date") -> DataFrame:
    """(transactions, weekend_transactions, weekend_pct)."""
    dow = F.dayofweek(F.col(date))
    return tx.agg(F.count(F.lit(1)).alias("transactions"),
                  F.count_if(dow.isin(1, 7)).alias("weekend_transactions")) \
        .withColumn("weekend_pct", F.coalesce(
            share_pct("weekend_transactions", "transactions"), F.lit(0.0)))


def _stores(tx: DataFrame, store: str) -> DataFrame:
    agg = tx.groupBy(F.col(store).alias("store_id")).agg(F.count(F.lit(1)).alias("transactions"))
    return with_share_of_total(agg, "transactions")


def store_distribution(tx: DataFrame, store: str = "store_id") -> DataFrame:
    """(store_id, transactions, pct), largest first (ties: store asc)."""
    return _stores(tx, store).orderBy(F.desc("transactions"), F.asc_nulls_last("store_id"))


def store_ranking(tx: DataFrame, store: str = "store_id") -> DataFrame:
    """(rank, store_id, transactions); equal counts share a rank."""
    d = _stores(tx, store)
    return d.select(F.rank().over(Window.orderBy(F.desc("transactions"))).alias("rank"),
                    "store_id", "transactions")


def store_gaps(tx: DataFrame, store: str = "store_id") -> DataFrame:
    """Distance of each store to the leader and to its neighbours.

    (store_id, transactions, gap_to_leader_pct, growth_to_next_pct,
    lead_over_next_pct): gap_to_leader = (leader - n) / leader;
    growth_to_next = (next higher - n) / n; lead_over_next = (n - next
    lower) / next lower; in percent, neighbours by (transactions desc,
    store asc).
    """
    d = _stores(tx, store)
    w = Window.orderBy(F.desc("transactions"), F.asc_nulls_last("store_id"))
    leader = F.max("transactions").over(Window.partitionBy())
    higher = F.lag("transactions").over(w)
    lower = F.lead("transactions").over(w)
    n = F.col("transactions")
    return d.select(
        "store_id", "transactions",
        share_pct(leader - n, leader).alias("gap_to_leader_pct"),
        share_pct(higher - n, n).alias("growth_to_next_pct"),
        share_pct(n - lower, lower).alias("lead_over_next_pct"))
