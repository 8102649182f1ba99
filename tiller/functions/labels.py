"""Fixed values that must equal the original analysis for identical output.

They are stated here once, in natural order, and used everywhere else.
"""

# --- fixed values -----------------------------------------------------------
# Weekday labels keyed by Spark's dayofweek (1 = Sunday ... 7 = Saturday).
WEEKDAY_LABELS = {
    1: "Domingo",
    2: "Lunes",
    3: "Martes",
    4: "Miércoles",
    5: "Jueves",
    6: "Viernes",
    7: "Sábado",
}
# Label for a weekday number outside 1..7 (never produced by dayofweek).
UNKNOWN_WEEKDAY = "Desconocido"
# Name given to a category code that has no row in the category table.
UNKNOWN_CATEGORY = "Desconocida"
# Scope label of the one-row global transaction summary.
SUMMARY_SCOPE = "Global"
# Forecast method labels.
METHOD_HOLT_WINTERS = "ExponentialSmoothing"
METHOD_SEASONAL_NAIVE = "Naive-Seasonal-Avg"
# Customer segments by number of purchases: (label, lowest count, highest
# count or None for open-ended, segment name).
CUSTOMER_SEGMENTS = [
    ("1", 1, 1, "Nuevos/Ocasionales"),
    ("2-3", 2, 3, "Esporádicos"),
    ("4-6", 4, 6, "Regulares"),
    ("7-10", 7, 10, "Frecuentes"),
    ("11-20", 11, 20, "Muy Frecuentes"),
    (">20", 21, None, "Leales/VIP"),
]
# Default parameters of the original analysis.
TOP_PRODUCTS_K = 30
PURCHASE_FREQUENCY_K = 20
RULES_MIN_SUPPORT = 0.02
RULES_MIN_CONFIDENCE = 0.3
RULES_TOP_K = 100
QUANTILE_ACCURACY = 10000
FORECAST_HORIZON = 6
SEASON_LENGTH = 12
# Months from which a series is fitted; shorter ones get the naive mean.
HOLT_WINTERS_MIN_MONTHS = 18
# Report rounding: decimals for shares, means and deviations; rule
# measures and retention rates keep four.
REPORT_DECIMALS = 2
REPORT_DECIMALS_FINE = 4
FINE_COLUMNS = ("confidence", "lift", "support", "retention_rate")
# Concentration cut-offs (top-N products) of the written report.
CONCENTRATION_CUTS = [5, 10, 30]
# Head / tail sizes of the category report.
HEAD_CATEGORIES = 10
TAIL_CATEGORIES = 5
# --- end of fixed values ----------------------------------------------------
