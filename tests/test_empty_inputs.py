"""Every operator accepts zero rows and returns its usual columns."""

import pytest

from tiller.operators import (
    baskets,
    catalogue,
    cohorts,
    customers,
    forecast,
    profile,
    rules,
    temporal,
)
from tiller.plans.report import transaction_summary

TX = "date date, store_id bigint, customer_id bigint, products string"
PC = "code_pr int, code int"
CAT = "id int, category_name string"
ITEMS = "tx_id bigint, item bigint"
SERIES = "store_id bigint, month date, transactions bigint"

CASES = {
    "schema_profile": lambda e: profile.schema_profile(e(TX)),
    "null_counts": lambda e: profile.null_counts(e(TX)),
    "exact_duplicates": lambda e: profile.exact_duplicates(e(TX)),
    "duplicates_on": lambda e: profile.duplicates_on(e(TX), ["date", "customer_id"]),
    "distinct_count": lambda e: profile.distinct_count(e(TX), "store_id"),
    "repeated_keys": lambda e: profile.repeated_keys(e(PC), "code_pr"),
    "orphans": lambda e: profile.orphans(e(PC), e(CAT), "code"),
    "orphan_summary": lambda e: profile.orphan_summary(e(PC), e(CAT), "code"),
    "catalogue_summary": lambda e: profile.catalogue_summary({"a": e(CAT), "b": e(PC)}),
    "quality_scorecard": lambda e: profile.quality_scorecard(e(TX), facts=e(PC), dim=e(CAT)),
    "category_distribution": lambda e: catalogue.category_distribution(e(PC), e(CAT)),
    "head_tail_categories": lambda e: catalogue.head_tail_categories(e(PC), e(CAT)),
    "multi_category_products": lambda e: catalogue.multi_category_products(e(PC)),
    "relation_averages": lambda e: catalogue.relation_averages(e(PC)),
    "category_relations": lambda e: catalogue.category_relations(e(PC)),
    "basket_statistics": lambda e: baskets.basket_statistics(e(TX)),
    "basket_summary": lambda e: baskets.basket_summary(e(TX)),
    "basket_statistics_from_lines": lambda e: baskets.basket_statistics_from_lines(e(ITEMS)),
    "basket_quantiles": lambda e: baskets.basket_quantiles(e(TX)),
    "basket_quantiles_approx": lambda e: baskets.basket_quantiles_approx(e(TX)),
    "basket_mode": lambda e: baskets.basket_mode(e(TX)),
    "basket_outliers": lambda e: baskets.basket_outliers(e(TX)),
    "basket_items": lambda e: baskets.basket_items(e(TX)),
    "units_sold": lambda e: baskets.units_sold(e(ITEMS)),
    "top_products": lambda e: baskets.top_products(e(ITEMS)),
    "pareto_products": lambda e: baskets.pareto_products(e(ITEMS)),
    "concentration": lambda e: baskets.concentration(e(ITEMS)),
    "token_counts": lambda e: baskets.token_counts(e("doc_id bigint, text string")),
    "date_range": lambda e: temporal.date_range(e(TX)),
    "monthly_distribution": lambda e: temporal.monthly_distribution(e(TX)),
    "monthly_series": lambda e: temporal.monthly_series(e(TX), by=("store_id",)),
    "monthly_growth": lambda e: temporal.monthly_growth(e(TX)),
    "weekday_distribution": lambda e: temporal.weekday_distribution(e(TX)),
    "weekday_ranking": lambda e: temporal.weekday_ranking(e(TX)),
    "weekend_share": lambda e: temporal.weekend_share(e(TX)),
    "store_distribution": lambda e: temporal.store_distribution(e(TX)),
    "store_ranking": lambda e: temporal.store_ranking(e(TX)),
    "store_gaps": lambda e: temporal.store_gaps(e(TX)),
    "purchase_frequency": lambda e: customers.purchase_frequency(e(TX)),
    "customer_segments": lambda e: customers.customer_segments(e(TX)),
    "new_customer_share": lambda e: customers.new_customer_share(e(TX)),
    "segment_rate": lambda e: customers.segment_rate(e(TX)),
    "top_customer": lambda e: customers.top_customer(e(TX)),
    "customer_gaps": lambda e: customers.customer_gaps(e(TX)),
    "inter_purchase_days": lambda e: customers.inter_purchase_days(e(TX)),
    "cohort_sizes": lambda e: cohorts.cohort_sizes(e(TX)),
    "cohort_activity": lambda e: cohorts.cohort_activity(e(TX)),
    "retention": lambda e: cohorts.retention(e(TX)),
    "retention_matrix": lambda e: cohorts.retention_matrix(e(TX)),
    "fill_months": lambda e: forecast.fill_months(e(SERIES), ("store_id",)),
    "seasonal_naive": lambda e: forecast.seasonal_naive(e(SERIES), ("store_id",)),
    "holt_winters": lambda e: forecast.holt_winters(e(SERIES), ("store_id",)),
    "forecast": lambda e: forecast.forecast(e(SERIES), ("store_id",)),
    "forecast_global": lambda e: forecast.forecast(e("month date, transactions bigint")),
    "transaction_summary": lambda e: transaction_summary(e(TX), e(ITEMS)),
    "frequent_itemsets": lambda e: rules.frequent_itemsets(e("items array<string>")),
    "association_rules": lambda e: rules.association_rules(e("items array<string>")),
}

ONE_ROW = {"null_counts", "exact_duplicates", "duplicates_on", "distinct_count", "repeated_keys",
           "basket_statistics_from_lines", "orphan_summary", "basket_statistics", "basket_summary", "basket_mode",
           "basket_outliers", "units_sold", "weekend_share", "new_customer_share",
           "inter_purchase_days", "multi_category_products", "relation_averages",
           "transaction_summary", "schema_profile", "catalogue_summary", "quality_scorecard",
           "category_relations", "basket_quantiles", "basket_quantiles_approx", "date_range"}


@pytest.mark.parametrize("name", sorted(CASES))
def test_zero_rows(spark, name):
    def empty(schema):
        return spark.createDataFrame([], schema)

    df = CASES[name](empty)
    out = df.collect()
    assert df.columns
    if name not in ONE_ROW:
        assert out == [], name
