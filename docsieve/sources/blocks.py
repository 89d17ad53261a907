"""Text blocks: the relation that the detectors read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.text import compact
from docsieve.sources.tables import table


def parsed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, section_no, paragraph_no, page, text): white space compacted, empty blocks left out, one row per block."""
    docs = table(spark, sf_dir, "parsed_documents", "id", "sections")
    s = docs.select(F.col("id").alias("document_id"), F.explode("sections").alias("s"))
    p = s.select("document_id", F.col("s.ordinal").alias("section_no"), F.posexplode("s.paragraphs").alias("n", "p"))
    out = p.select("document_id", "section_no", (F.col("n") + 1).alias("paragraph_no"), F.col("p.page").alias("page"), compact(F.col("p.text")).alias("text"))
    return out.where("text <> ''").distinct()


def located_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, section_no, first_page): the first paragraph of a section that has a page."""
    docs = table(spark, sf_dir, "parsed_documents", "id", "sections")
    s = docs.select(F.col("id").alias("document_id"), F.explode("sections").alias("s")).distinct()
    page = F.try_element_at(F.filter("s.paragraphs", lambda p: p["page"].isNotNull()), F.lit(1))["page"]
    return s.select("document_id", F.col("s.ordinal").alias("section_no"), page.alias("first_page")).distinct()
