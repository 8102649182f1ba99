"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiller.llm import (
    op1_token_counts,
    op2_near_dedup,
    op3_quality_rules,
    op4_secret_scan,
    op5_mixing,
    op6_line_dedup,
    op7_decontamination,
    op8_quality_classifier,
    op9_substring_dedup,
    op10_token_files,
    op11_embedding_dedup,
    op12_vector_codes,
    op13_whitening,
    sql,
)
from tiller.llm.common import ship, table

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op1_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    counts = op1_token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                           public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share most of their 4-word shingles."""
    return op2_near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op3_quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether the rules keep it."""
    judged = op3_quality_rules.judge(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "labels"))
    return judged.drop("stratum")


def op4_secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the fixed kinds, and all spans."""
    found = op4_secret_scan.scan(table(spark, sf_dir, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*op4_secret_scan.BASE))

    def count(kind):
        own = F.filter("spans", lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in op4_secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def word_count(text):
    """Words of a text; none for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def op5_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; its one source is its membership."""
    taken, targets = op5_mixing.mix(table(spark, sf_dir, "documents"), "doc_id",
                                    word_count(F.col("text")), F.array("source"))
    source = F.col("pattern")[0]
    sizes = taken.groupBy(source.alias("source")).agg(F.sum("size").alias("source_size"))
    goals = spark.createDataFrame(list(targets.items()), "source string, target double")
    # a row for each source, at most MOST_PATTERNS
    per_source = sizes.join(goals, sizes.source.eqNullSafe(goals.source)).select(
        sizes.source, "source_size", "target")
    return (taken.withColumn("of", source)
            .join(F.broadcast(per_source), F.col("of").eqNullSafe(F.col("source")))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op6_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after, and the digest of what stays."""
    kept = op6_line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a benchmark item shares."""
    marked = op7_decontamination.contamination(table(spark, sf_dir, "documents"),
                                               table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         op7_decontamination.contaminated().alias("contaminated"))


def held_out(doc_id):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op8_quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels not held out."""
    scored = op8_quality_classifier.add_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        ~held_out(F.col("id")))
    cutoff = op8_quality_classifier.CUTOFF
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op9_substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without 400-byte strings that occur elsewhere.

    ``n_repeat_words`` counts its words in passages of over 50 words that do.
    """
    op = op9_substring_dedup
    return op.remove_repeats(
        table(spark, sf_dir, "documents"),
        passages=(op.PASSAGE, op.PASSAGE_GRAM, op.PASSAGE_BLOCK)).drop("kept")


def op10_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, read back."""
    path = op10_token_files.new_path(spark)
    op10_token_files.write_token_files(table(spark, sf_dir, "documents"),
                                       public_tokenizers.path(VOCABULARY), path)
    return op10_token_files.document_index(spark, path)


def op11_embedding_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of 0.9 or more."""
    return op11_embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_vector_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every embedding, their errors and the codebooks' digest."""
    return op12_vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading whitened components."""
    return op13_whitening.whiten(table(spark, sf_dir, "embeddings"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts_query,
    "op2_near_dedup": op2_near_dedup_query,
    "op3_quality_rules": op3_quality_rules_query,
    "op4_secret_scan": op4_secret_scan_query,
    "op5_mixing": op5_mixing_query,
    "op6_line_dedup": op6_line_dedup_query,
    "op7_decontamination": op7_decontamination_query,
    "op8_quality_classifier": op8_quality_classifier_query,
    "op9_substring_dedup": op9_substring_dedup_query,
    "op10_token_files": op10_token_files_query,
    "op11_embedding_dedup": op11_embedding_dedup_query,
    "op12_vector_codes": op12_vector_codes_query,
    "op13_whitening": op13_whitening_query,
}
SPARK = {name: _shipped(query) for name, query in SPARK.items()}

SQL: dict[str, str] = dict(sql.SQL)
