from tiller.functions.columns import (  # noqa: F401
    basket_size,
    basket_tokens,
    is_missing,
    month_start,
    months_apart,
    share_pct,
    weekday_label,
    with_share_of_total,
)
