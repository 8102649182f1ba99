"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides keep the smallest k-gram hash of every run of ``window - k + 1``
k-grams, so any shared span of ``window`` words shares a kept fingerprint.
Documents without a benchmark fingerprint are settled by an equi-join of
fingerprints; in the others every hit is extended to exact ``window``-word spans:
their windows are joined with those of the items and their words are marked.
Items shorter than a window are one window of their own length, and documents
keep every gram of such a length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import lower_az, sized, staged, text_or_empty

WINDOW = 13
GRAM = 6
#: Characters that separate words, after A-Z are in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(text), NOT_WORD, -1), "")


def grams(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)),
                                      lambda i: F.xxhash64(F.slice(words, i, k)))
                  ).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, width: int) -> Column:
    """Distinct smallest hashes of all runs of ``width``; of all, if there are fewer."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (width - 1))),
                       lambda i: F.array_min(F.slice(hashes, i, width)))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _prints(words: DataFrame, short: list[int], keep: list[str]) -> DataFrame:
    """``keep``, n_words and the fingerprints of a table of words."""
    hashed = words.select(*keep, F.size("words").alias("n_words"), grams(F.col("words"), GRAM)
                          .alias("grams"), *(grams(F.col("words"), k).alias(f"of_{k}") for k in short))
    return hashed.select(*keep, "n_words", F.concat(
        winnowed(F.col("grams"), WINDOW - GRAM + 1), *(F.col(f"of_{k}") for k in short)
    ).alias("prints"))


def _windows(words: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """(keep, width, at, hash) of all windows of the given widths."""
    arrays = words.select(*keep, *(grams(F.col("words"), k).alias(f"of_{k}") for k in lengths))
    # an inner explode would put a filter on the array's size below the step that
    # makes its words, which would then be split again for every window
    parts = [arrays.select(*keep, F.lit(k).alias("width"),
                           F.posexplode_outer(f"of_{k}").alias("at", "hash"))
             for k in lengths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("hash is not null")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  ) -> DataFrame:
    """``(id, n_words, n_hit, items)`` of every row of ``docs``.

    ``n_hit`` counts the words inside occurrences of item windows and ``items``
    lists the ids, as sorted strings, of the items with such windows.  NULL and
    empty texts have no words, items without words match nothing, repeated rows
    each give a row, and items that share an id are one item.  Items without an
    id count in ``n_hit`` like any and are not listed.  Other columns are ignored.
    """
    item_words = staged(items.select(F.col(item_id).cast("string").alias("item"), words_of(
        text_or_empty(F.col(item_text))).alias("words")).where(F.size("words") > 0).distinct(),
        "item-words")
    # at most WINDOW - 1 numbers
    short = sorted(r[0] for r in item_words.where(F.size("words") < WINDOW)
                   .select(F.size("words")).distinct().collect())
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(text, F.lit(1)).alias("key"))
    words = rows.select("id", "key", words_of(F.col("text")).alias("words"))
    prints = staged(_prints(words, short, ["id", "key"]), "document-prints")

    whole = item_words.where(F.size("words") >= WINDOW)
    item_prints = _prints(whole, [], []).select(F.explode_outer("prints").alias("print"))
    for k in short:
        item_prints = item_prints.unionByName(item_words.where(F.size("words") == k).select(
            F.explode_outer(grams(F.col("words"), k)).alias("print")))
    suspects = (prints.select("key", F.explode("prints").alias("print"))
                .join(sized(staged(item_prints.distinct(), "item-prints")), "print", "left_semi")
                .select("key").distinct())

    suspects = staged(suspects, "suspects")
    suspect_words = (rows.select("key", "text").join(sized(suspects), "key", "left_semi")
                     .dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("words")))
    lengths = [*short, WINDOW]
    item_windows = _windows(whole, ["item"], [WINDOW])
    for k in short:
        item_windows = item_windows.unionByName(
            _windows(item_words.where(F.size("words") == k), ["item"], [k]))
    # rows of a few numbers only: a window's items are joined to its hits, never listed by window
    item_windows = staged(item_windows.select("width", "hash", "item").distinct(), "item-windows")
    windows = staged(item_windows.select("width", "hash").distinct(), "windows")
    hits = staged(_windows(suspect_words, ["key"], lengths)
                  .join(sized(windows), ["width", "hash"]).select("key", "at", "width", "hash"),
                  "window-hits")
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(
        "at", (F.col("at") + F.col("width")).alias("stop")))).alias("spans"))
    n_hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["at"]))).alias("n"),
            F.greatest(a["end"], s["stop"]).alias("end")),
        lambda a: a["n"])
    found = (hits.select("key", "width", "hash").distinct()
             .join(item_windows.where("item is not null"), ["width", "hash"])
             .select("key", "item").distinct()
             .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")))
    # a read table, so that the rows of many copies of one text can be split
    marked = staged(spans.select("key", n_hit.alias("n_hit")).join(found, "key", "left"), "marked")
    return prints.select("id", "key", "n_words").join(marked, "key", "left").select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """Any hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
