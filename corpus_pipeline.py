"""From raw documents to token files: five stages, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read as the next one's docs.
All stages but the last return the columns of ``documents``.  Every row is judged
by its own text, also where rows share an id or have none; NULL texts count as
empty; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiller.llm import (
    op2_near_dedup,
    op5_mixing,
    op7_decontamination,
    op8_quality_classifier,
    op10_token_files,
)
from tiller.llm.common import ship, sized, staged, table, text_or_empty
from tiller.llm.queries import VOCABULARY, held_out, word_count


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship(spark)
    scored = op8_quality_classifier.add_scores(
        docs, table(spark, sf_dir, "labels"), ~held_out(F.col("id")), score_col="_score")
    return scored.where(F.col("_score") >= op8_quality_classifier.CUTOFF).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The one with the smallest id (NULL last) stays.  Texts without words are
    copies of nothing.
    """
    ship(spark)
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", text_or_empty(F.col("text"))))
    judged = staged(op2_near_dedup.near_duplicates(keyed, id_col="_key")
                    .where("n_shingles > 0").groupBy("_key")
                    .agg(F.min("component_id").alias("of"), F.count(F.lit(1)).alias("n")), "judged")
    names = staged(keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id")), "names")
    first = staged(judged.join(names, "_key").groupBy("of").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_key")), "first")
    gone = judged.join(first, "_key", "left_anti").select("_key")
    again = judged.where("n > 1").join(first, "_key", "left_semi").select("_key")
    kept = keyed.join(sized(staged(gone, "near-copies")), "_key", "left_anti")
    # rows with one id and one text: the smallest of them, partially aggregated
    again = sized(staged(again, "same-rows"))
    one = kept.join(again, "_key", "left_semi").groupBy("_key").agg(
        F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(again, "_key", "left_anti").select(*docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship(spark)
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text")))
    marked = op7_decontamination.contamination(keyed, table(spark, sf_dir, "benchmark"),
                                               id_col="_key")
    gone = marked.where(op7_decontamination.contaminated()).select(F.col("_key").alias("_gone"))
    gone = sized(staged(gone.distinct(), "contaminated"))
    return keyed.join(gone, F.col("_key").eqNullSafe(F.col("_gone")), "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each time a document is taken.

    Documents stay whole: the one that the mix takes in part stays if that part
    is half of it or more.
    """
    ship(spark)
    key = F.struct("doc_id", F.xxhash64("text"))
    taken, _ = op5_mixing.mix(docs.withColumn("_key", key), "_key", word_count(F.col("text")),
                              F.array("source"))
    copies = taken.groupBy("_key").agg(
        F.floor(F.try_divide(F.sum("taken"), F.sum("size")) + 0.5).cast("int").alias("_copies"))
    copies = staged(copies.where("_copies > 0"), "copies")
    keyed = docs.withColumn("_of", key).join(sized(copies), F.col("_of").eqNullSafe(F.col("_key")))
    return keyed.withColumn("_nth", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: each document's place and checksum."""
    ship(spark)
    path = op10_token_files.new_path(spark)
    op10_token_files.write_token_files(docs, public_tokenizers.path(VOCABULARY), path)
    return op10_token_files.document_index(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

#: SQL cannot express the classifier, so none is given; the tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
