"""Parsed documents and references written as TEI and read back, against the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.sources import tei
from docsieve.sources.tables import table


def _esc(c: Column) -> Column:
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b-\x1f]", " ")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _coords(page: Column, box: Column) -> Column:
    """The box as two halves, which the reader puts together again; a third one on another page doesn't count."""
    text = [x.cast("decimal(18,4)").cast("string") for x in (box[0], box[1], (box[2] - box[0]) / 2, box[3] - box[1], box[0] + (box[2] - box[0]) / 2)]
    halves = F.concat(page.cast("string"), F.lit(","), F.concat_ws(",", text[0], text[1], text[2], text[3]), F.lit(";"), page.cast("string"), F.lit(","), F.concat_ws(",", text[4], text[1], text[2], text[3]), F.lit(";"), (page + 1).cast("string"), F.lit(",0,0,900,900"))
    return F.coalesce(F.when(F.size(box) == 4, F.concat(F.lit(' coords="'), halves, F.lit('"'))), F.lit(""))


def _person(name: Column) -> Column:
    words = F.split(F.trim(_esc(name)), r"\s+")
    fore = F.array_join(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.concat(F.lit("<forename>"), w, F.lit("</forename>"))), "")
    return F.concat(F.lit("<author><persName>"), fore, F.lit("<surname>"), F.element_at(words, -1), F.lit("</surname></persName></author>"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_documents", F.col("id").alias("document_id"), "title", "authors", "abstract", "language", "sections", "page_map").distinct()

    def paragraph(x: Column) -> Column:
        return F.concat(F.lit("<p"), _coords(x["page"], x["bbox"]), F.lit(">"), _esc(x["text"]), F.lit("</p>"))

    def division(s: Column) -> Column:
        return F.concat(F.lit("<div><head>"), _esc(s["heading"]), F.lit("</head>"), F.array_join(F.transform(s["paragraphs"], paragraph), ""), F.lit("</div>"))

    def surface(m: Column) -> Column:
        return F.concat(F.lit('<surface n="'), m["page"].cast("string"), F.lit('" lrx="'), m["width"].cast("string"), F.lit('" lry="'), m["height"].cast("string"), F.lit('"/>'))

    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:lang="'), _esc(F.col("language")), F.lit('"><teiHeader><fileDesc><titleStmt><title>other</title><title type="main">'), _esc(F.col("title")), F.lit("</title></titleStmt><sourceDesc>"),
        F.array_join(F.transform(F.filter("authors", lambda a: F.trim(a) != ""), _person), ""), F.lit("</sourceDesc></fileDesc><profileDesc><abstract><p>"), _esc(F.col("abstract")), F.lit("</p></abstract></profileDesc></teiHeader><facsimile>"), F.array_join(F.transform(F.coalesce("page_map", F.array()), surface), ""),
        F.lit("</facsimile><text><body>"), F.array_join(F.transform("sections", division), ""), F.lit("</body></text></TEI>"),
    )
    return tei.parse_tei(p.select("document_id", xml.alias("xml")), "document_id", "xml")


def tei_documents(spark: SparkSession, d: str) -> DataFrame:
    """Title, authors, abstract and sizes of every document."""
    return _documents(spark, d).select("document_id", "title", F.array_join("authors", "; ").alias("authors"), "abstract", F.size("sections").alias("sections"), F.size("page_map").alias("pages"), F.aggregate("page_map", F.lit(0.0), lambda a, m: a + m["width"]).alias("widths"))


def tei_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every section with its heading, first place and paragraphs."""
    s = _documents(spark, d).select("document_id", F.explode("sections").alias("s"))
    return s.select("document_id", F.col("s.ordinal").alias("ordinal"), F.col("s.heading").alias("heading"), F.col("s.page").alias("page"), F.round(F.col("s.bbox")[2], 2).alias("right"), F.size("s.paragraphs").alias("paragraphs"), F.aggregate("s.paragraphs", F.lit(0), lambda a, p: a + F.length(p["text"])).alias("characters"))


def tei_references(spark: SparkSession, d: str) -> DataFrame:
    """The references of every task with status and confidence."""
    r = table(spark, d, "reference_sources", "task_id", "ordinal", "raw_citation", "title", "authors", "year", "venue", "doi", "page", "bbox").where("task_id is not null").distinct()

    def element(name: str, c: Column, attributes: str = "") -> Column:
        return F.coalesce(F.when(F.trim(c) != "", F.concat(F.lit(f"<{name}{attributes}>"), _esc(c), F.lit(f"</{name}>"))), F.lit(""))

    entry = F.concat(
        F.lit("<biblStruct"), _coords(F.col("page"), F.col("bbox")), F.lit("><analytic>"), element("title", F.col("title"), ' level="a"'), F.array_join(F.transform(F.filter(F.coalesce("authors", F.array()), lambda a: F.trim(a) != ""), _person), ""), element("idno", F.col("doi"), ' type="doi"'), F.lit("</analytic><monogr>"),
        F.coalesce(F.when(F.col("year").isNotNull(), F.concat(F.lit('<imprint><date when="'), _esc(F.col("year")), F.lit('-05"/></imprint>'))), F.lit("")), F.lit("</monogr>"), element("note", F.col("raw_citation"), ' type="raw_reference"'), F.lit("</biblStruct>"),
    )
    lists = r.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("x")))).alias("_x"))  # the references of one task
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><back><listBibl>'), F.array_join(F.transform("_x", lambda x: x["x"]), ""), F.lit("</listBibl></back></text></TEI>"))
    read = tei.parse_tei(lists.select("task_id", xml.alias("xml")), "task_id", "xml").select("task_id", F.explode("references").alias("r"))
    return read.select("task_id", "r.ordinal", "r.raw_citation", "r.title", F.size("r.authors").alias("authors"), "r.year", "r.doi", "r.parse_status", "r.failure_reason", "r.confidence", "r.page")


QUERIES = {"tei_documents": tei_documents, "tei_sections": tei_sections, "tei_references": tei_references}

_FLAT = r"nullif(trim(regexp_replace({0}, '[\s\x00-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')), '')"
_NAMES = f"list_filter(list_transform(authors, lambda a: {_FLAT.format('a')}), lambda a: a IS NOT NULL)"
SQL = {
    "tei_documents": f"SELECT id AS document_id, coalesce({_FLAT.format('title')}, 'other') AS title, array_to_string(list_filter({_NAMES}, lambda a, i: list_position({_NAMES}, a) = i), '; ') AS authors, {_FLAT.format('abstract')} AS abstract, CAST(len(sections) AS INT) AS sections, CAST(coalesce(len(page_map), 0) AS INT) AS pages, CAST(coalesce(list_sum(list_transform(page_map, lambda m: m.width)), 0) AS DOUBLE) AS widths FROM (SELECT DISTINCT id, title, authors, abstract, sections, page_map FROM parsed_documents)",
    "tei_sections": f"""WITH s AS (SELECT id, s FROM (SELECT id, unnest(sections) AS s FROM (SELECT DISTINCT id, sections FROM parsed_documents))),
 p AS (SELECT id, s.ordinal AS ordinal, {_FLAT.format('s.heading')} AS heading, list_filter(s.paragraphs, lambda p: {_FLAT.format('p.text')} IS NOT NULL) AS ps FROM s)
 SELECT id AS document_id, ordinal, coalesce(heading, concat('section ', ordinal)) AS heading, list_filter(ps, lambda p: p.page IS NOT NULL AND len(p.bbox) = 4)[1].page AS page, round(list_filter(ps, lambda p: p.page IS NOT NULL AND len(p.bbox) = 4)[1].bbox[3], 2) AS "right", CAST(len(ps) AS INT) AS paragraphs, CAST(coalesce(list_sum(list_transform(ps, lambda p: length({_FLAT.format('p.text')}))), 0) AS INT) AS characters FROM p""",
    "tei_references": f"""WITH r AS (SELECT DISTINCT task_id, ordinal, raw_citation, title, authors, year, doi, page, bbox FROM reference_sources WHERE task_id IS NOT NULL),
 f AS (SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY ordinal) AS INT) AS ordinal, {_FLAT.format('raw_citation')} AS raw_citation, {_FLAT.format('title')} AS title, CAST(len(list_distinct({_NAMES.replace('authors', 'coalesce(authors, [])')})) AS INT) AS authors, left(concat(year, '-05'), 4) AS y, year, {_FLAT.format('doi')} AS doi, CASE WHEN len(bbox) = 4 THEN page END AS page FROM r),
 g AS (SELECT *, title IS NOT NULL OR (authors > 0 AND year IS NOT NULL) AS parsed FROM f)
 SELECT task_id, ordinal, coalesce(raw_citation, concat('reference ', ordinal)) AS raw_citation, title, authors, CASE WHEN year IS NOT NULL THEN y END AS year, doi, CASE WHEN parsed THEN 'parsed' ELSE 'failed' END AS parse_status, CASE WHEN NOT parsed THEN 'bibliographic_fields_missing' END AS failure_reason, CAST(CASE WHEN title IS NOT NULL AND authors > 0 THEN 1.0 WHEN parsed THEN 0.7 ELSE 0.0 END AS DOUBLE) AS confidence, page FROM g""",
}
