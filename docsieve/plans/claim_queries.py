"""Queries of the rule and citation detectors on generated claims, with SQL that works from the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import citations, detectors
from docsieve.operators import evidence as E
from docsieve.plans.claims import claims, sql
from docsieve.sources.settle import settle

CITATION_BUDGET = 40
THRESHOLD_BUDGET, AVERAGE_BUDGET, LIST_BUDGET = 5, 4, 7
WHOLE = 2**31 - 1  # no budget: the largest row number; above it the optimizer drops the numbering, and whole records move instead of slim rows
DOC = "document_id"
_RULES = "document-rules/1.0"


def claim_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Every threshold claim with its calculation."""
    c = detectors.threshold_claims(claims(spark, d, "thresholds"), DOC, ["block_idx"])
    return detectors.with_calculation(c).select(DOC, "block_idx", "page", "claim", "value", "uncertainty", "threshold", "upper", "calculation", "consistent")


def claim_averages(spark: SparkSession, d: str) -> DataFrame:
    """Every reported average with its calculation."""
    c = detectors.average_claims(claims(spark, d, "averages"), DOC, ["block_idx"])
    return c.select(DOC, "block_idx", "page", "claim", "unit", "computed", "reported", detectors.average_calculation().alias("calculation"), "consistent")


def claim_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Equal values under different conditions: what is reported against what."""
    m = detectors.measurement_contexts(claims(spark, d, "measurements"), [DOC, "block_idx", "page", "bbox"])
    c = detectors.condition_conflicts(m, DOC, ["block_idx"])
    return c.select(DOC, "value", "unit", "n_conditions", F.array_join("conditions", "|").alias("conditions"), "baseline", F.col("subject.o.block_idx").alias("subject_block"), F.col("source.o.block_idx").alias("source_block"))


def claim_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Results of different subjects put together, with the wording found."""
    return detectors.cross_condition(claims(spark, d, "subjects")).select(DOC, "block_idx", "page", "marker")


def stat_checks(spark: SparkSession, d: str) -> DataFrame:
    """Statistical checks of each document, each calculation once, the first kept."""
    return _stat_checks(spark, d).select(DOC, "kind", "page", "calculation", "consistent")


def _stat_checks(spark: SparkSession, d: str, **budgets) -> DataFrame:
    t = detectors.with_calculation(detectors.threshold_claims(claims(spark, d, "thresholds"), DOC, ["block_idx"], **{k: v for k, v in budgets.items() if k == "budget"})).where("value is not null")
    a = detectors.average_claims(claims(spark, d, "averages"), DOC, ["block_idx"]).where("computed is not null").withColumn("calculation", detectors.average_calculation())
    both = t.select(DOC, F.lit("threshold_with_uncertainty").alias("kind"), "claim", "page", "calculation", "consistent").unionByName(a.select(DOC, F.lit("reported_average").alias("kind"), "claim", "page", "calculation", "consistent"))
    return both.groupBy(DOC, "kind", "calculation").agg(F.min_by(F.struct("page", "consistent"), "claim").alias("f")).select(DOC, "kind", "f.page", "calculation", "f.consistent")


def stat_budgets(spark: SparkSession, d: str) -> DataFrame:
    """What was examined in each document under small budgets, and whether they ran out."""
    t = detectors.threshold_claims(claims(spark, d, "thresholds"), DOC, ["block_idx"], budget=THRESHOLD_BUDGET)
    a = detectors.average_claims(claims(spark, d, "averages"), DOC, ["block_idx"], budget=AVERAGE_BUDGET, lists=LIST_BUDGET)
    t = t.groupBy(DOC).agg(F.count_if("examined").alias("threshold_claims_examined"), F.max((~F.col("examined")).cast("int")).alias("_t"))
    a = a.groupBy(DOC).agg(F.count_if("examined").alias("average_claims_examined"), F.sum("compared").alias("value_list_comparisons"), F.max((~F.col("examined") | (F.col("compared") < F.col("_lists"))).cast("int")).alias("_a"))
    return t.join(a, DOC).select(DOC, "threshold_claims_examined", "average_claims_examined", "value_list_comparisons", F.greatest("_t", "_a").alias("budget_exhausted"))


def _rules(spark: SparkSession, d: str) -> list[DataFrame]:
    """Evidence of each rule detector, in their order, without budgets."""
    at = E.location(F.col(DOC), F.col("page"), F.col("bbox"))
    subjects = claims(spark, d, "subjects")
    m = detectors.measurement_contexts(claims(spark, d, "measurements"), [DOC, "block_idx", "page", "bbox"])
    m = detectors.condition_conflicts(m, DOC, ["block_idx", "page", "bbox"])
    t = detectors.threshold_claims(claims(spark, d, "thresholds"), DOC, ["block_idx"], budget=WHOLE).where("consistent = false")
    a = detectors.average_claims(claims(spark, d, "averages"), DOC, ["block_idx"], budget=WHOLE, lists=2**63 - 1).where("consistent = false")
    rules = E.method("document-rules")
    return [
        E.build(detectors.cross_condition(subjects), seq=1, code="cross_condition_subject_mismatch", category="evidence_limitation", severity="medium", confidence=0.94, subject=at, subject_excerpt=T.excerpt_around(F.col("text"), F.col("marker")), explanation="Results of different subjects stand side by side.", method=rules),
        E.build(
            m, seq=2, code="measurement_condition_inconsistency", category="internal_consistency", severity="medium", confidence=0.86, subject=E.location(F.col(DOC), F.col("subject.o.page"), F.col("subject.o.bbox")), subject_excerpt=T.excerpt_around(F.col("subject.text"), F.col("subject.marker")),
            source=E.location(F.col(DOC), F.col("source.o.page"), F.col("source.o.bbox")), source_excerpt=T.excerpt_around(F.col("source.text"), F.col("source.marker")), explanation=F.concat(F.col("subject.marker"), F.lit(" stands under several conditions: "), F.array_join("conditions", ", "), F.lit(".")), method=rules,
        ),
        E.build(t, seq=3, code="statistical_threshold_uncertainty", category="statistical_consistency", severity="medium", confidence=0.99, subject=at, subject_excerpt=T.excerpt_around(F.col("text"), F.col("marker")), explanation=F.concat(F.lit("With its uncertainty the value crosses the threshold: "), F.col("calculation"), F.lit(".")), method=E.method("document-rules", parameters={"calculation": F.col("calculation")})),
        E.build(a, seq=4, code="statistical_average_inconsistency", category="statistical_consistency", severity="medium", confidence=0.99, subject=at, subject_excerpt=T.excerpt_around(F.col("text"), F.col("marker")), explanation=F.concat(F.lit("The listed values give another average: "), F.col("calculation"), F.lit(".")), method=rules),
        E.build(detectors.data_on_request(subjects), seq=9, code="data_not_directly_available", category="reproducibility", severity="medium", confidence=0.99, subject=at, subject_excerpt=F.col("text"), explanation="The data can be had on request only.", method=rules),
    ]


def _support(spark: SparkSession, d: str, budget: int | None) -> DataFrame:
    cited = settle(claims(spark, d, "cited"), "cited")  # one row for each work, read at several places
    none = F.lit(None).cast("string")
    works = cited.select(DOC, "ordinal", "doc_idx", "source_id", F.concat(F.lit("Work "), F.col("source_id")).alias("title"), none.alias("doi"), F.sha2("source_id", 256).alias("sha256"), F.col("source_id").alias("reference_id"))
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    filler = cited.select("source_id", F.lit(0).alias("source_idx"), F.lit(1).alias("source_page"), box.alias("source_bbox"), F.lit("Parcel ledger kept by clerks.").alias("source_text"))
    blocks = cited.select("source_id", F.lit(1).alias("source_idx"), F.lit(2).alias("source_page"), box.alias("source_bbox"), "source_text")
    return citations.support(claims(spark, d, "citing"), works, filler.unionByName(blocks), budget=budget)


def citation_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every citation context with its outcome."""
    s = _support(spark, d, CITATION_BUDGET)
    return s.select(DOC, "block_idx", "ctx", "comparisons", "outcome", F.round("score", 6).alias("score"), F.array_join("missing", ",").alias("missing"), F.col("best.ordinal").alias("source_ordinal"))


def citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The nine counters of each document."""
    return citations.coverage(_support(spark, d, CITATION_BUDGET), budget=CITATION_BUDGET)


def _parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """Each detector's records with identity and version, of all claims and all citations."""
    parts = [*_rules(spark, d), citations.findings(_support(spark, d, None))]
    return [E.identify(p, F.sha2(DOC, 256), F.sha2(F.lit("index"), 256)) for p in parts]


def _collapsed(parts: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """All records, equal ones once.  Codes differ between the parts and are part of the fingerprint, so each part is collapsed where its rows are."""
    return E.union([E.collapse(p, columns) for p in parts])


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """All detectors' records with identity and version, equal ones once."""
    e = _collapsed(_parts(spark, d))
    s, r = F.col("subject_location"), F.col("source_location")
    return e.select(
        DOC, "code", "category", "status", "severity", "confidence", s["page"].alias("page"), F.array_join(F.transform(s["bbox"], lambda x: x.cast("int").cast("string")), ",").alias("bbox"), r["document_id"].alias("source_document"), r["page"].alias("source_page"),
        "subject_excerpt", "source_excerpt", "fingerprint", "evidence_version", "collapsed", F.size("artifacts").alias("artifacts"), F.round("method.score", 6).alias("score"),
    )


def evidence_rerun(spark: SparkSession, d: str) -> DataFrame:
    """A second run over the stored one: records of one key are overwritten, a new version is added beside the old."""
    parts = _parts(spark, d)
    columns = ["seq", "code", "explanation"]  # what is counted
    first = _collapsed(parts, columns).drop("collapsed")
    # of the second run only the parts with the codes that it changes: the others needn't be planned again
    data, citing = (p.select(*E.KEY, *[F.lit("again").alias(c) if c == "explanation" else c for c in [*columns, "source_location", "source_excerpt"]]) for p in parts[-2:])
    newer = data.where("code = 'data_not_directly_available'").withColumn("evidence_version", F.concat(F.col("evidence_version"), F.lit("-next")))
    merged = E.merge(E.merge(first, citing.where("code like 'citation%'")), newer)
    return merged.groupBy("code", (F.col("explanation") == "again").alias("again"), F.col("evidence_version").endswith("-next").alias("next")).agg(F.count("*").alias("n"))


def evidence_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every record in its document's listing."""
    from pyspark.sql import Window as W

    e = _collapsed(_parts(spark, d), ["seq", "subject_location", "source_location"]).drop("collapsed")
    place = F.row_number().over(W.partitionBy(DOC).orderBy(*E.in_order()))
    return e.select(DOC, "fingerprint", place.alias("place"))


QUERIES = {
    "claim_thresholds": claim_thresholds, "claim_averages": claim_averages, "claim_conditions": claim_conditions, "claim_subjects": claim_subjects, "stat_checks": stat_checks, "stat_budgets": stat_budgets,
    "citation_outcomes": citation_outcomes, "citation_coverage": citation_coverage, "evidence": evidence, "evidence_rerun": evidence_rerun, "evidence_order": evidence_order,
}

_T = f"""t AS (SELECT *, CAST(l_quantity AS INT) AS q, l_linenumber + 0.5 AS u, l_suppkey % 60 + 1 AS lim, CAST(row_number() OVER (PARTITION BY document_id ORDER BY block_idx) AS INT) AS claim FROM ({sql('thresholds')})),
 tc AS (SELECT *, q + u < lim AS consistent, concat(q, ' + ', l_linenumber, '.5 = ', q + l_linenumber, '.5 ', CASE WHEN q + u < lim THEN '<' ELSE '≥' END, ' ', lim) AS calculation FROM t)"""
_A = f"""a AS (SELECT *, CAST(l_quantity AS INT) AS q, l_suppkey % 7 AS w, CAST(l_quantity AS INT) % 9 + l_partkey % 5 AS rep, CAST(row_number() OVER (PARTITION BY document_id ORDER BY block_idx) AS INT) AS claim FROM ({sql('averages')})),
 ac AS (SELECT *, (q + q + l_linenumber + 2 + w) / 4.0 AS computed, abs((q + q + l_linenumber + 2 + w) / 4.0 - rep) <= greatest(0.05, 0.05 * rep) AS consistent,
  concat('mean(', q, ', ', q + l_linenumber, ', 2, ', w, ') = ', format('{{:g}}', (q + q + l_linenumber + 2 + w) / 4.0), '; reported ≈ ', rep, ' ns') AS calculation FROM a)"""
_M = f"""m AS (SELECT *, CAST(p_size AS STRING) AS value, CASE p_partkey % 3 WHEN 0 THEN '10 k' WHEN 1 THEN '77 k' ELSE '300 k' END AS c FROM ({sql('measurements')})),
 g AS (SELECT document_id, value, c, count(*) AS n, min(block_idx) AS f FROM m GROUP BY ALL),
 b AS (SELECT document_id, value, CAST(count(*) AS INT) AS n_conditions, list_sort(list(c)) AS conditions, arg_min(c, (-n, f)) AS baseline FROM g GROUP BY ALL HAVING count(*) >= 2),
 o AS (SELECT document_id, value, arg_min(c, f) AS c1, min(f) AS f1 FROM g GROUP BY ALL),
 p AS (SELECT document_id, value, min(block_idx) AS f2, arg_min(c, block_idx) AS c2 FROM m JOIN o USING (document_id, value) WHERE m.c <> o.c1 GROUP BY ALL),
 mc AS (SELECT document_id, value, 'ns' AS unit, n_conditions, conditions, baseline, CASE WHEN c2 = baseline AND c1 <> baseline THEN f1 ELSE f2 END AS subject_block, CASE WHEN c2 = baseline AND c1 <> baseline THEN f2 ELSE f1 END AS source_block FROM b JOIN o USING (document_id, value) JOIN p USING (document_id, value))"""
_CITING = f"""w AS (SELECT DISTINCT document_id, ordinal, source_id, source_text, 10 + (o_custkey % 39 + 1 + o_custkey % 4) % 5 AS held FROM ({sql('cited')})),
 c0 AS (SELECT *, o_orderkey % 7 AS kind, 1 + o_custkey % 4 AS k, 10 + o_orderkey % 5 AS said FROM ({sql('citing')}) WHERE o_orderkey % 7 <> 3),
 c1 AS (SELECT c0.*, w.source_id, w.source_text, w.held, CAST(row_number() OVER (PARTITION BY c0.document_id ORDER BY block_idx) AS INT) AS ctx, kind NOT IN (4, 5) AS scores FROM c0 JOIN w ON w.document_id = c0.document_id AND w.ordinal = c0.k)"""


def _outcomes(rows: str, comparisons: str, cut: str = "") -> str:
    return f"""cs AS (SELECT *, CAST(CASE WHEN scores THEN {comparisons} ELSE 0 END AS BIGINT) AS comparisons,
  CASE WHEN kind = 4 THEN 'no_source' WHEN kind = 5 THEN 'missing_source' {cut}WHEN kind = 6 THEN 'unaligned' WHEN kind = 1 THEN 'direction' WHEN kind = 2 THEN 'ambiguous' WHEN said <> held THEN 'numeric' ELSE 'match' END AS outcome,
  CASE kind WHEN 0 THEN 5 / (sqrt(5.0) * sqrt(6.0)) WHEN 1 THEN 4 / (sqrt(5.0) * sqrt(6.0)) ELSE 4 / (sqrt(7.0) * sqrt(6.0)) END AS score FROM {rows})"""


_C = f"""{_CITING},
 c2 AS (SELECT *, sum(CASE WHEN scores THEN 2 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ctx) AS run FROM c1),
 {_outcomes('c2', f'greatest(0, least(2, 2 - run + {CITATION_BUDGET}))', f"WHEN run > {CITATION_BUDGET} THEN 'budget' ")}"""
_C_WHOLE = f"{_CITING}, {_outcomes('c1', '2')}"
_LOC = "struct_pack(bbox := {box}, char_end := CAST(NULL AS INT), char_start := CAST(NULL AS INT), document_id := {doc}, page := {page}, word_end := CAST(NULL AS INT), word_start := CAST(NULL AS INT))"
_BOXED = "[CAST({0} AS DOUBLE), 10.0::DOUBLE, {0} + 0.5::DOUBLE, 20.0::DOUBLE]"


def _record(code: str, category: str, severity: str, confidence: str, source: str, *, page: str = "page", subject: str = "text", other: str | None = None, other_page: str = "", other_box: str = "", excerpt: str = "NULL", where: str = "true", artifacts: int = 0, score: str = "NULL") -> str:
    location = _LOC.format(box=_BOXED.format(page), doc="document_id", page=f"CAST({page} AS INT)")
    far = _LOC.format(box=other_box, doc=other, page=f"CAST({other_page} AS INT)") if other else "NULL"
    return (
        f"SELECT document_id, '{code}' AS code, '{category}' AS category, 'needs_review' AS status, '{severity}' AS severity, CAST({confidence} AS DOUBLE) AS confidence, CAST({page} AS INT) AS page, concat({page}, ',10,', {page}, ',20') AS bbox, "
        f"CAST({other or 'NULL'} AS STRING) AS source_document, CAST({other_page or 'NULL'} AS INT) AS source_page, {subject} AS subject_excerpt, CAST({excerpt} AS STRING) AS source_excerpt, {artifacts} AS artifacts, round(CAST({score} AS DOUBLE), 3) AS score, "
        f"sha256(CAST(to_json(struct_pack(code := '{code}', source_location := {far}, subject_excerpt := {subject}, subject_location := {location})) AS STRING)) AS fingerprint FROM {source} WHERE {where}"
    )


_PARTS = [
    _record("cross_condition_subject_mismatch", "evidence_limitation", "medium", "0.94", f"({sql('subjects')})", where="c_custkey % 4 < 2"),
    _record(
        "measurement_condition_inconsistency", "internal_consistency", "medium", "0.86", "(SELECT mc.document_id, x.page, x.text, y.page AS page2, y.text AS text2 FROM mc JOIN m x ON x.document_id = mc.document_id AND x.block_idx = mc.subject_block JOIN m y ON y.document_id = mc.document_id AND y.block_idx = mc.source_block)",
        other="document_id", other_page="page2", other_box=_BOXED.format("page2"), excerpt="text2",
    ),
    _record("statistical_threshold_uncertainty", "statistical_consistency", "medium", "0.99", "tc", where="NOT consistent"),
    _record("statistical_average_inconsistency", "statistical_consistency", "medium", "0.99", "ac", where="NOT consistent"),
    _record("data_not_directly_available", "reproducibility", "medium", "0.99", f"({sql('subjects')})", where="c_custkey % 4 = 2"),
    _record("citation_direction_conflict_candidate", "citation_support", "high", "round(least(0.96, 0.55 + 0.4 * score), 3)", "cs", other="source_id", other_page="2", other_box="[0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE]", excerpt="source_text", where="outcome = 'direction'", artifacts=1, score="score"),
    _record("citation_numeric_mismatch_candidate", "citation_support", "medium", "round(least(0.96, 0.55 + 0.4 * score), 3)", "cs", other="source_id", other_page="2", other_box="[0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE]", excerpt="source_text", where="outcome = 'numeric'", artifacts=1, score="score"),
]
_ALL = f"WITH {_T}, {_A}, {_M}, {_C_WHOLE}, parts AS ({' UNION ALL '.join(_PARTS)})"
_EVIDENCE = f"""{_ALL}, e AS (SELECT *, concat(sha256(document_id), ':{_RULES}:', left(sha256('index'), 16)) AS evidence_version FROM parts),
 ev AS (SELECT document_id, code, category, status, severity, confidence, page, bbox, source_document, source_page, subject_excerpt, min(source_excerpt) AS source_excerpt, fingerprint, evidence_version, count(*) - 1 AS collapsed, CAST(artifacts AS INT) AS artifacts, min(score) AS score FROM e GROUP BY ALL)"""

SQL = {
    "claim_thresholds": f"WITH {_T}, {_A} SELECT document_id, block_idx, page, claim, CAST(q AS DOUBLE) AS value, CAST(u AS DOUBLE) AS uncertainty, CAST(lim AS DOUBLE) AS threshold, CAST(q + u AS DOUBLE) AS upper, calculation, consistent FROM tc",
    "claim_averages": f"WITH {_T}, {_A} SELECT document_id, block_idx, page, claim, 'ns' AS unit, CAST(computed AS DOUBLE) AS computed, CAST(rep AS DOUBLE) AS reported, calculation, consistent FROM ac",
    "claim_conditions": f"WITH {_M} SELECT document_id, value, unit, n_conditions, array_to_string(conditions, '|') AS conditions, baseline, subject_block, source_block FROM mc",
    "claim_subjects": f"SELECT document_id, block_idx, page, CASE c_custkey % 4 WHEN 0 THEN 'different patients' ELSE 'not recorded from the same samples' END AS marker FROM ({sql('subjects')}) WHERE c_custkey % 4 < 2",
    "stat_checks": f"WITH {_T}, {_A}, s AS (SELECT document_id, 'threshold_with_uncertainty' AS kind, claim, page, calculation, consistent FROM tc UNION ALL SELECT document_id, 'reported_average', claim, page, calculation, consistent FROM ac) SELECT document_id, kind, page, calculation, consistent FROM s QUALIFY row_number() OVER (PARTITION BY document_id, kind, calculation ORDER BY claim) = 1",
    "stat_budgets": f"WITH {_T}, {_A}, n AS (SELECT document_id, count(*) AS n FROM t GROUP BY 1) SELECT document_id, least(n, {THRESHOLD_BUDGET}) AS threshold_claims_examined, least(n, {AVERAGE_BUDGET}, {LIST_BUDGET // 2 + 1}) AS average_claims_examined, CAST(least(2 * least(n, {AVERAGE_BUDGET}), {LIST_BUDGET}) AS BIGINT) AS value_list_comparisons, CAST(n > {THRESHOLD_BUDGET} OR n > {AVERAGE_BUDGET} OR 2 * n > {LIST_BUDGET} AS INT) AS budget_exhausted FROM n",
    "citation_outcomes": f"WITH {_C} SELECT document_id, block_idx, ctx, comparisons, outcome, CASE WHEN outcome IN ('direction', 'ambiguous', 'numeric', 'match') THEN round(score, 6) END AS score, CASE WHEN outcome IN ('direction', 'ambiguous', 'numeric', 'match') THEN CASE WHEN said <> held THEN CAST(said AS STRING) ELSE '' END END AS missing, CASE WHEN outcome IN ('direction', 'ambiguous', 'numeric', 'match') THEN CAST(k AS INT) END AS source_ordinal FROM cs",
    "citation_coverage": f"WITH {_C} SELECT document_id, count(*) AS citation_contexts_detected, count(*) FILTER (outcome <> 'no_source') AS citation_contexts_with_full_text, count(*) FILTER (outcome = 'match') AS citation_support_matches, count(*) FILTER (outcome IN ('no_source', 'missing_source', 'budget', 'unaligned', 'ambiguous')) AS citation_support_unresolved, count(*) FILTER (outcome = 'numeric') AS citation_numeric_mismatches, count(*) FILTER (outcome = 'direction') AS citation_direction_conflicts, CAST(sum(comparisons) AS BIGINT) AS citation_candidate_comparisons, CAST({CITATION_BUDGET} AS BIGINT) AS citation_candidate_budget, CAST(max(CASE WHEN outcome = 'budget' THEN 1 ELSE 0 END) AS INT) AS citation_candidate_budget_exhausted FROM cs GROUP BY 1",
    "evidence": f"{_EVIDENCE} SELECT * FROM ev",
    "evidence_rerun": f"{_EVIDENCE} SELECT code, again, next, n FROM (SELECT code, code LIKE 'citation%' AS again, false AS next, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT code, true, true, count(*) FROM ev WHERE code = 'data_not_directly_available' GROUP BY ALL)",
    "evidence_order": f"{_EVIDENCE} SELECT document_id, fingerprint, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, coalesce(source_document, ''), CASE code WHEN 'cross_condition_subject_mismatch' THEN 1 WHEN 'measurement_condition_inconsistency' THEN 2 WHEN 'statistical_threshold_uncertainty' THEN 3 WHEN 'statistical_average_inconsistency' THEN 4 WHEN 'data_not_directly_available' THEN 9 WHEN 'citation_direction_conflict_candidate' THEN 20 ELSE 21 END, fingerprint) AS INT) AS place FROM ev",
}
