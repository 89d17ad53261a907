"""Queries of the training-data operators."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.canonical import normalize_text
from docsieve.llm.languages import fit_model, label_documents, language_cases
from docsieve.llm.leaks import leak_spans, leaks
from docsieve.llm.matching import match_records
from docsieve.llm.name_links import link_names, name_classes
from docsieve.llm.packing import bucket_report, containers
from docsieve.llm.personal import find_personal, learn_given, pseudonymise, redact_personal
from docsieve.llm.same_look import same_look_classes, same_look_pairs
from docsieve.llm.scan_repair import repair_documents, scan_defects, vocabulary_of
from docsieve.llm.shared_spans import paragraphs, shared_by_paragraph
from docsieve.plans.packed_queries import p7_found
from docsieve.sources.tables import table


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): every author of references, documents and submissions, one row for each occurrence."""
    lists = [table(spark, sf_dir, t, F.explode("authors").alias("name")) for t in ("reference_sources", "parsed_documents")]
    return lists[0].unionAll(lists[1]).unionAll(p7_found(spark, sf_dir).select(F.col("author").alias("name")))


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "research_submissions", "id", "reason", "review_summary").distinct()


def _secret(spark: SparkSession) -> str:
    """The key of the pseudonyms: ``spark.docsieve.pseudonym.key``; without it a new one, so pseudonyms link within this result only."""
    return spark.conf.get("spark.docsieve.pseudonym.key", None) or secrets.token_hex(32)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, field, kind, value): every personal datum in the two free texts of a submission."""
    given = learn_given(_spellings(spark, sf_dir))
    return find_personal(_submissions(spark, sf_dir), "id", ["reason", "review_summary"], given).withColumnRenamed("id", "submission_id")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, reason, review_summary): the texts with typed placeholders that carry pseudonyms."""
    given = learn_given(_spellings(spark, sf_dir))
    return redact_personal(_submissions(spark, sf_dir), ["reason", "review_summary"], _secret(spark), given).withColumnRenamed("id", "submission_id")


def p1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, field, kind, value, pseudonym): the found data with what stands for them."""
    return pseudonymise(p1_found(spark, sf_dir), _secret(spark))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, section_no, paragraph_no, shared_chars): paragraphs with at least 200 characters that stand in another document."""
    return shared_by_paragraph(table(spark, sf_dir, "parsed_documents", "id", "sections"))


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, n_chars, shared_chars): how much of each document is shared elsewhere."""
    parsed = table(spark, sf_dir, "parsed_documents", "id", "sections")
    each = paragraphs(parsed).groupBy("document_id", "section_no", "paragraph_no").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))  # deliveries of one record
    size = each.groupBy("document_id").agg(F.sum("n").alias("n_chars"))
    shared = shared_by_paragraph(parsed).groupBy("document_id").agg(F.sum("shared_chars").alias("shared_chars"))
    return size.join(shared, "document_id", "left").na.fill(0, ["shared_chars"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, section_no, paragraph_no, kind, item): every scan defect."""
    return scan_defects(_parsed_texts(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, section_no, paragraph_no, text): the repaired paragraphs of scanned documents."""
    parsed = _parsed_texts(spark, sf_dir)
    return repair_documents(parsed, vocabulary_of(parsed)).select("document_id", "section_no", "paragraph_no", "text").distinct()


def _parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_documents", "id", "title", "authors", "abstract", "sections")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reference_id, work_id): references and catalogue records of the same work."""
    return p4_matches(spark, sf_dir).select("reference_id", "work_id")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reference_id, work_id, rule, confidence): the same with the rule that matched and its precision."""
    refs = table(spark, sf_dir, "reference_sources", "id", "raw_citation", "title", "authors", "year", "venue")
    return match_records(refs, table(spark, sf_dir, "catalog_works", "work_id", "title", "creators", "pub_year", "container", "pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, section_no, paragraph_no, lang): missing or wrong labels, and paragraphs with foreign sentences."""
    return language_cases(_labelled(spark, sf_dir))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, label, lang, confidence): the language of every document."""
    return _labelled(spark, sf_dir).select("document_id", "label", "lang", F.round("confidence", 6).alias("confidence")).distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, section_no, paragraph_no, lang, confidence, text): every foreign segment."""
    seg = _labelled(spark, sf_dir).select("document_id", F.explode("segments").alias("s"))
    return seg.select("document_id", "s.section_no", "s.paragraph_no", "s.lang", F.round("s.confidence", 6).alias("confidence"), "s.text").distinct()


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "parsed_documents", "id", "title", "language", "sections")
    return label_documents(parsed, fit_model(parsed))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name_a, name_b): pairs of different spellings of one person or organisation."""
    return link_names(_spellings(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, class_id, links): every spelling with its class and its number of links."""
    return name_classes(_spellings(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_id, doc_id, part, token_start, token_end, n_tokens, bucket): documents combined into containers of 2,048 tokens."""
    return containers(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, n_items, n_tokens, padding): the length buckets with the least padding."""
    return bucket_report(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold 25 consecutive words of an item's passage."""
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "passage"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, word_start, word_end): the spans to remove."""
    return leak_spans(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "passage"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b): documents that look the same but differ in their characters."""
    return same_look_pairs(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, links): the same as classes, one row for each document."""
    return same_look_classes(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, canonical): every text in the one consistent form."""
    return normalize_text(table(spark, sf_dir, "documents", "doc_id", "text"), "text").select("doc_id", "canonical")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p1_pseudonyms": p1_pseudonyms, "p6_found": p6_found, "p6_classes": p6_classes, "p4_found": p4_found, "p4_matches": p4_matches, "p3_found": p3_found, "p3_repaired": p3_repaired, "p5_found": p5_found, "p5_languages": p5_languages, "p5_segments": p5_segments, "p2_found": p2_found, "p2_documents": p2_documents, "p8_containers": p8_containers, "p8_buckets": p8_buckets, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_classes": p10_classes, "p10_canonical": p10_canonical}
# Brute force: every window of 200 characters of every paragraph, those of several documents kept, the covered characters counted.
_PARAGRAPHS = "p AS (SELECT DISTINCT document_id, s.ordinal AS section_no, CAST(n AS INTEGER) AS paragraph_no, x.text AS text FROM (SELECT document_id, s, generate_subscripts(s.paragraphs, 1) AS n, unnest(s.paragraphs) AS x FROM (SELECT id AS document_id, unnest(sections) AS s FROM parsed_documents)))"
_SHARED = f"""WITH {_PARAGRAPHS}, w AS (SELECT document_id, section_no, paragraph_no, i, substr(text, i, 200) AS g FROM (SELECT *, unnest(range(1, length(text) - 198)) AS i FROM p WHERE length(text) >= 200)),
 h AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT document_id) > 1), c AS (SELECT document_id, section_no, paragraph_no, i, lead(i) OVER (PARTITION BY document_id, section_no, paragraph_no ORDER BY i) AS j FROM w SEMI JOIN h USING (g)),
 f AS (SELECT document_id, section_no, paragraph_no, CAST(sum(least(200, coalesce(j - i, 200))) AS INTEGER) AS shared_chars FROM c GROUP BY 1, 2, 3)"""
SQL: dict[str, str] = {
    "p2_found": f"{_SHARED} SELECT * FROM f",
    "p2_documents": f"{_SHARED} SELECT document_id, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, CAST(coalesce(any_value(s), 0) AS BIGINT) AS shared_chars FROM p LEFT JOIN (SELECT document_id, sum(shared_chars) AS s FROM f GROUP BY 1) USING (document_id) GROUP BY 1",
}
