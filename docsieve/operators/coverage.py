"""What a review covered, as one row for each document: coverage is part of the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the result contract: what counts as a mention of statistics, and the flags that say a budget ran out.
MENTION = r"(?i)±|p\s*[<=>]|g\s*\(\s*2\s*\)|FWHM|lifetime|\baverage\b"
FLAGS = ["reference_candidate_budget_exhausted", "semantic_candidate_budget_exhausted", "citation_candidate_budget_exhausted", "statistical_review_budget_exhausted", "image_region_budget_exhausted", "image_resource_budget_exhausted"]


def mentions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MENTION))


def any_exhausted(df: DataFrame, columns: list[str] = FLAGS) -> Column:
    """Whether one of the flags that are there is set."""
    there = [F.coalesce(F.col(c), F.lit(0)) for c in columns if c in df.columns]
    return (F.greatest(*there, F.lit(0)) if there else F.lit(0)) == 1


def percent(part: Column, whole: Column) -> Column:
    """A share in whole per cent; null of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole).cast("int"))


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value=count;..): how often each value stands, sorted."""
    n = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    parts = F.array_sort(F.collect_list(F.concat(F.col(value), F.lit("="), F.col("_n").cast("string"))))
    return n.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(parts, ";").alias("histogram"))


def summary(blocks: DataFrame, documents: DataFrame, references: DataFrame, *extras: DataFrame) -> DataFrame:
    """Counters of each document; ``extras``: further counters by document_id, such as those of citations, statistics and images.

    blocks: (document_id, page, text); documents: (document_id, task_id,
    page_map); references: (id, task_id, parse_status, metadata_status,
    full_text_status).
    """
    zero = F.lit(0)
    read = blocks.groupBy("document_id").agg(
        F.count_distinct("page").alias("pages_with_text"), F.count("*").alias("text_blocks_reviewed"), F.sum(mentions(F.col("text"))).alias("statistical_mentions_detected"),
        F.max(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))).alias("highest_citation"),
    )
    refs = references.groupBy("task_id").agg(
        F.count("*").alias("references_total"), F.count_if(F.col("parse_status") == "failed").alias("references_failed"), F.count_if(F.col("metadata_status") == "resolved").alias("references_metadata_resolved"), F.count_if(F.col("full_text_status").isin("obtained", "obtained_no_text")).alias("reference_full_texts_obtained"),
    )
    why = histogram(references.where("full_text_status <> 'obtained'"), "task_id", "full_text_status").withColumnRenamed("histogram", "failure_reasons")
    j = documents.join(read, "document_id", "left").join(refs, "task_id", "left").join(why, "task_id", "left")
    counters = ["pages_with_text", "text_blocks_reviewed", "statistical_mentions_detected", "highest_citation", "references_total", "references_failed", "references_metadata_resolved", "reference_full_texts_obtained"]
    out = j.select("document_id", F.coalesce(F.size("page_map"), zero).alias("pages_total"), *[F.coalesce(c, zero).alias(c) for c in counters], F.coalesce("failure_reasons", F.lit("")).alias("failure_reasons"))
    out = out.withColumn("parsed_percent", percent(F.col("references_total") - F.col("references_failed"), F.col("references_total")))
    for extra in extras:
        out = out.join(extra, "document_id", "left").na.fill(0)
    return out.withColumn("budget_exhausted", any_exhausted(out)) if extras else out
