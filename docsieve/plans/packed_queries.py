"""Queries of problem 7 (several values in one field)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators.packed import source_scores, split_packed
from docsieve.sources.tables import table


def packed_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with the source of their notation: the domain of the submitter's address."""
    domain = F.nullif(F.lower(F.regexp_extract("submitter_email", r"@([^@\s]+)\s*$", 1)), F.lit(""))
    return table(spark, sf_dir, "research_submissions", "id", "authors", domain.alias("source")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, pos, author): one row for each author in research_submissions.authors."""
    return split_packed(packed_authors(spark, sf_dir), "id", "authors", source="source").withColumnRenamed("id", "submission_id").distinct()


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, delims, prior): what speaks for each combination of delimiters in each source."""
    return source_scores(packed_authors(spark, sf_dir), "authors", "source").select("source", "delims", F.round("prior", 6).alias("prior"))


QUERIES = {"p7_found": p7_found, "p7_sources": p7_sources}
SQL: dict[str, str] = {}
