"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Rules compare simple text statistics with cutoffs.  Labelled rows, on which
nothing was fitted, select the cutoffs: for every stratum and rule the strictest
cutoff of a fixed grid is used for which an exact binomial test rejects, on the
stratum's labelled good texts, that more than ``risk`` of good texts would be
dropped.  The level is divided by the number of tests (Bonferroni), so with
probability ``1 - error`` no stratum loses more than ``risk`` of its good texts
to any one rule.  A stratum with too few labels proves nothing and keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import SPACES, staged, text_or_empty

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MOST_REPEAT_PERCENT = 20
WINDOW = 5
RISK, ERROR = 0.005, 0.05
GRID = [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.17, 0.23, 0.3, 0.4, 0.5, 0.65, 0.8]


def words_of(text: Column) -> Column:
    """The words of a text: runs without \\x20 and \\x09-\\x0D."""
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " ", -1), "")


def window_hashes(words: Column, k: int = WINDOW) -> Column:
    """64-bit hashes of the windows of ``k`` words; NULL if there is at most one."""
    n = F.size(words)
    return F.when(n > k, F.transform(F.sequence(F.lit(1), n - (k - 1)),
                                     lambda i: F.xxhash64(F.slice(words, i, k))))


def sorted_windows(h: Column) -> Column:
    """(hash, position) of all windows in order of the hash, if any hash repeats."""
    again = F.size(F.array_distinct(h)) < F.size(h)
    return F.when(again, F.array_sort(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))


def repeated_positions(by_hash: Column) -> Column:
    """Positions, in order, of the windows whose hash a neighbour shares."""

    def twin(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(by_hash, i - 1)["h"] == x["h"], F.lit(False)) | \
            F.coalesce(F.get(by_hash, i + 1)["h"] == x["h"], F.lit(False))

    return F.array_sort(F.transform(F.filter(by_hash, twin), lambda x: x["p"]))


def covered_words(at: Column, k: int = WINDOW) -> Column:
    """Words within the windows at the given positions: gaps between them, at most ``k`` each."""
    total = F.aggregate(
        at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"),
                              p.alias("last")),
        lambda a: a["n"])
    return F.coalesce(total, F.lit(0).cast("long"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: The rules: shares in a text; one above its stratum's cutoff drops the text.
RULES = {
    "symbols": lambda c: share(c("n_symbols"), c("word_chars")),
    "capitals": lambda c: share(c("n_capitals"), c("word_chars")),
    "exclamations": lambda c: share(c("n_exclamations"), c("word_chars")),
    "duplicate_lines": lambda c: share(c("n_dup_lines"), c("n_lines")),
    "repeated_words": lambda c: share(c("n_repeat_words"), c("n_words")),
}


def features(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """``(id, stratum, text_hash, statistics...)`` of every row; NULL texts have no words."""
    text = text_or_empty(F.col(text_col))
    chars = F.char_length("text")

    def without(characters: str) -> Column:
        return F.char_length(F.translate("text", characters, ""))

    base = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
                       text.alias("text"))
    split = base.select(
        "id", "stratum", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1),
                 lambda x: F.char_length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"),
        without(SPACES).alias("word_chars"), (chars - without(SYMBOLS)).alias("n_symbols"),
        (chars - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        (chars - without("!")).alias("n_exclamations"))
    counted = split.select(
        "*", F.size("words").alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("windows"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_capitals",
             "n_exclamations", "n_lines"]
    kept = ["id", "stratum", "text_hash", *longs]
    # a lambda evaluates what it closes over for each element, so every array it
    # looks into is a column of the step before
    ordered = counted.select(*kept, sorted_windows(F.col("windows")).alias("by_hash"))
    twins = ordered.select(*kept, repeated_positions(F.col("by_hash")).alias("at"))
    return twins.select("id", "stratum", "text_hash", *(F.col(c).cast("long") for c in longs),
                        covered_words(F.col("at")).alias("n_repeat_words"))


def log_binomial_tail(n: Column, x: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= x), summed exactly in logarithms; x must be below n * p."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    terms = F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(
        F.array().cast("array<bigint>"))

    def step(a: Column, i: Column) -> Column:
        term = a.getField("term") + F.log((n - i + 1) / i) + odds
        most = F.greatest(a.getField("sum"), term)
        least = F.least(a.getField("sum"), term)
        return F.struct(term.alias("term"), (most + F.log1p(F.exp(least - most))).alias("sum"))

    return F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), step,
                       lambda a: a.getField("sum"))


def thresholds(stats: DataFrame, labels: DataFrame, label_col: str, risk: float = RISK,
               error: float = ERROR, grid: list[float] = GRID) -> DataFrame:
    """``(stratum, cutoffs)``: each stratum's map from rule to cutoff.

    ``labels`` has id and the label (1 good, 0 bad; others count as no label, a
    document with several labels is good only if all are).  Copies of a text
    count once.  Of the cutoffs that pass the test, the one is taken that drops
    the most bad texts for good ones lost, the loosest of equals.
    """
    marked = (labels.where(F.col(label_col).isin(0, 1)).groupBy("id")
              .agg(F.min(label_col).alias("label")))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), sum(
        ((rule(F.col) > g).cast("int") for g in grid), F.lit(0)).alias("bin"))
        for name, rule in RULES.items()))
    rows = (stats.where(~base_failed()).join(marked, "id")
            .groupBy("stratum", "text_hash", "n_words", "word_chars")
            .agg(F.min("label").alias("label"), F.first(rules).alias("rules"))
            .select("stratum", "label", F.explode("rules").alias("r"))
            .groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.bin").alias("bin"))
            .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")))
    cutoffs = F.explode(F.arrays_zip(F.array(*map(F.lit, grid)).alias("cutoff"),
                                     F.sequence(F.lit(1), F.lit(len(grid))).alias("at")))
    totals = rows.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"),
                                                 F.sum("bad").alias("n_bad"))
    tests = totals.select("*", cutoffs.alias("c")).select(
        "stratum", "rule", "n_good", "n_bad", F.col("c.cutoff").alias("cutoff"),
        F.col("c.at").alias("at"))
    lost = (tests.alias("t").join(rows.alias("r"), F.col("t.stratum").eqNullSafe(F.col("r.stratum"))
                                  & (F.col("t.rule") == F.col("r.rule"))
                                  & (F.col("r.bin") >= F.col("t.at")))
            .groupBy("t.stratum", "t.rule", "t.cutoff", "n_good", "n_bad")
            .agg(F.sum("good").alias("lost"), F.sum("bad").alias("caught")))
    strata = rows.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    level = F.log(F.lit(error) / (F.lit(len(RULES) * len(grid)) * strata))
    passed = (lost.where(F.col("lost") < F.col("n_good") * risk)
              .where(log_binomial_tail(F.col("n_good"), F.col("lost"), risk) <= level))
    gain = share(F.col("caught"), F.col("n_bad")) - 10 * share(F.col("lost"), F.col("n_good"))
    best = passed.groupBy("stratum", "rule").agg(
        F.max_by("cutoff", F.struct(gain, F.col("cutoff"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(
        F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK,
          error: float = ERROR) -> DataFrame:
    """Every row with its statistics, ``base_failed`` and ``kept``.

    NULL and empty texts have no words and fail the base rules.  A NULL stratum
    is a stratum.  Rows that share an id are judged each by its own text; labels
    go to all of them, and without labels (an empty table, NULL ids or labels)
    the base rules alone decide.  Columns of ``docs`` beside the three named are
    ignored.
    """
    stats = staged(features(docs, id_col, text_col, stratum_col), "rule-statistics")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias(label_col))
    cuts = thresholds(stats, marks, label_col, risk, error).withColumnRenamed("stratum", "of")
    above = F.lit(False)
    for name, rule in RULES.items():
        cutoff = F.coalesce(F.col("cutoffs")[name], F.lit(float("inf")))
        above = above | (rule(F.col) > cutoff)
    joined = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return joined.select(
        F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & ~above).alias("kept"))
