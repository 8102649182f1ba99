from tiller.sources.readers import (  # noqa: F401
    CATEGORIES_SCHEMA,
    PRODUCT_CATEGORY_SCHEMA,
    RAW_TRANSACTIONS_SCHEMA,
    TRANSACTIONS_SCHEMA,
    read_categories,
    read_catalogue,
    read_product_category,
    read_transactions,
    read_transactions_raw,
    source_files,
    typed_transactions,
)
from tiller.sources.sinks import write_csv, write_json, write_sections  # noqa: F401
