"""DataFrame -> DataFrame operators, grouped by subject."""

from tiller.operators import (  # noqa: F401
    baskets,
    catalogue,
    cohorts,
    customers,
    forecast,
    profile,
    rules,
    temporal,
)
