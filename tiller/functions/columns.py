"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiller.functions.labels import UNKNOWN_WEEKDAY, WEEKDAY_LABELS

_FLOATING = (T.FloatType, T.DoubleType)


def is_missing(field: T.StructField) -> Column:
    """Missing-value predicate chosen from the column type.

    NULL everywhere; additionally NaN for floating columns and the empty
    string for string columns.  Other types only test NULL, because an
    equality with ``""`` would fail on dates under ANSI casting.
    """
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _FLOATING):
        return c.isNull() | F.isnan(c)
    if isinstance(field.dataType, T.StringType):
        return c.isNull() | (c == F.lit(""))
    return c.isNull()


def basket_tokens(products: str | Column = "products") -> Column:
    """Raw tokens of a basket string: split on one space, empty tokens kept."""
    c = F.col(products) if isinstance(products, str) else products
    return F.split(c, " ")


def basket_size(products: str | Column = "products") -> Column:
    """Number of raw tokens (NULL for a NULL basket, whatever the session's
    ``sizeOfNull`` setting)."""
    c = F.col(products) if isinstance(products, str) else products
    return F.when(c.isNotNull(), F.size(basket_tokens(c)))


def share_pct(n: str | Column, total: str | Column) -> Column:
    """``n * 100 / total`` in double precision (NULL when total is 0)."""
    n = F.col(n) if isinstance(n, str) else n
    total = F.col(total) if isinstance(total, str) else total
    return F.try_divide(n.cast("double") * F.lit(100.0), total.cast("double"))


def with_share_of_total(df: DataFrame, n: str, out: str = "pct") -> DataFrame:
    """Append ``n``'s share of the column total.

    Only for already aggregated, small inputs: the un-partitioned window
    moves every row into one task.
    """
    total = F.sum(F.col(n)).over(Window.partitionBy())
    return df.withColumn(out, share_pct(F.col(n), total))


def weekday_label(dow: str | Column) -> Column:
    """Spanish weekday name for Spark's 1 = Sunday numbering."""
    dow = F.col(dow) if isinstance(dow, str) else dow
    pairs = []
    for k, v in WEEKDAY_LABELS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[dow], F.lit(UNKNOWN_WEEKDAY))


def month_start(date: str | Column) -> Column:
    date = F.col(date) if isinstance(date, str) else date
    return F.trunc(date, "MM")


def months_apart(later: Column, earlier: Column) -> Column:
    """Whole months between two month starts, as INT."""
    return F.floor(F.months_between(later, earlier)).cast("int")
