"""Frequent itemsets and association rules (ML1, ML2) with Spark ML's
parallel FP-growth.

Baskets are de-duplicated first (FP-growth rejects a basket that repeats an
item) and blank tokens are removed.  Fitting is an action run inside the
operators: the cleaned baskets are held while they are counted and mined, so the
input is read once, and released after; the itemsets stay held, for rules and
later reads take them from there, until the next mining run or :func:`release`; results
read after that mine their itemsets again.  Itemsets and rules are reported with their
items sorted and joined by ``,`` so the output does not depend on mining order.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.functions.columns import basket_tokens
from tiller.functions.labels import RULES_MIN_CONFIDENCE, RULES_MIN_SUPPORT, RULES_TOP_K

ITEM_SEP = ","


def clean_baskets(df: DataFrame, items: str = "items") -> DataFrame:
    """(items): distinct, non-blank items of each non-NULL basket."""
    arr = F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull() & (x != F.lit(""))))
    return df.where(F.col(items).isNotNull()).select(arr.alias("items"))


def baskets_from_products(tx: DataFrame, products: str = "products") -> DataFrame:
    """(items) from basket strings - the original analysis's input."""
    return clean_baskets(tx.select(basket_tokens(products).alias("items")))


def fit(baskets: DataFrame, min_support: float = RULES_MIN_SUPPORT,
        min_confidence: float = RULES_MIN_CONFIDENCE,
        num_partitions: int | None = None) -> FPGrowthModel:
    """Fit FP-growth on already clean baskets (``items`` array column)."""
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    return fp.fit(baskets)


class Mined:
    """A fitted model with its baskets' count and its itemsets, held; the last one alone."""

    def __init__(self, baskets: DataFrame, min_support: float, min_confidence: float,
                 num_partitions: int | None = None):
        release()  # one result is held at a time
        held = baskets.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.n = held.count()
            self.model = fit(held, min_support, min_confidence, num_partitions)
            self.itemsets = self.model.freqItemsets.persist(StorageLevel.MEMORY_AND_DISK)
            self.itemsets.count()
        finally:
            held.unpersist()
        _MINED.append(self)


_MINED: list[Mined] = []


def release() -> None:
    """Let go of the itemsets of all results so far."""
    while _MINED:
        _MINED.pop().itemsets.unpersist()


def _joined(c):
    return F.array_join(F.sort_array(c), ITEM_SEP)


def frequent_itemsets(baskets: DataFrame, min_support: float = RULES_MIN_SUPPORT,
                      num_partitions: int | None = None, mined: Mined | None = None) -> DataFrame:
    """ML1: (itemset, size, freq, support) for every frequent itemset."""
    mined = mined or Mined(baskets, min_support, RULES_MIN_CONFIDENCE, num_partitions)
    return mined.itemsets.select(
        _joined(F.col("items")).alias("itemset"), F.size("items").alias("size"), F.col("freq"),
        (F.col("freq").cast("double") / F.lit(float(mined.n))).alias("support"))


def association_rules(baskets: DataFrame, min_support: float = RULES_MIN_SUPPORT,
                      min_confidence: float = RULES_MIN_CONFIDENCE,
                      k: int | None = RULES_TOP_K, num_partitions: int | None = None,
                      mined: Mined | None = None) -> DataFrame:
    """ML2: (antecedent, consequent, confidence, lift, support), strongest
    lift first (ties: antecedent, consequent); the first ``k`` rules when
    ``k`` is given (a top-k report, as in the original analysis)."""
    mined = mined or Mined(baskets, min_support, min_confidence, num_partitions)
    r = mined.model.associationRules.select(
        _joined(F.col("antecedent")).alias("antecedent"),
        _joined(F.col("consequent")).alias("consequent"),
        "confidence", "lift", "support")
    r = r.orderBy(F.desc("lift"), "antecedent", "consequent")
    return r.limit(k) if k is not None else r
