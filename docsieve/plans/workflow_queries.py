"""Queries of the lookup and workflow operators on rows made by SQL that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import alignment, lookup, workflow
from docsieve.sources.tables import table

NOW = "TIMESTAMP '2024-06-01 00:00:00'"
# name: SELECT over tables in braces, valid in both engines
MADE = {
    "evidence": "SELECT o_orderkey AS evidence_id, concat('task-', CAST(o_custkey % 97 AS STRING)) AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 'data_not_directly_available' WHEN 1 THEN 'statistical_average_inconsistency' ELSE 'citation_direction_conflict_candidate' END AS code, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, CAST(0.5 AS DOUBLE) + (o_orderkey % 5) * CAST(0.1 AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 7 AS INT) END AS page, concat('v', CAST(o_orderkey % 2 AS STRING)) AS evidence_version, o_orderdate AS created_at FROM {orders}",
    "decisions": "SELECT event_id AS decision_id, concat('task-', CAST(user_id % 97 AS STRING)) AS task_id, CASE WHEN event_id % 10 > 0 THEN event_id % 4001 END AS evidence_id, CASE event_id % 3 WHEN 0 THEN 'data_not_directly_available' WHEN 1 THEN 'statistical_average_inconsistency' ELSE 'other' END AS evidence_code, CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'needs_material' WHEN 2 THEN 'insufficient' ELSE 'reasonable' END AS decision, concat('because <', event_type, '> & more') AS reason, ts AS created_at FROM {events}",
    "requests": "SELECT event_id AS request_no, CASE user_id % 2 WHEN 0 THEN 'parse' ELSE 'check' END AS kind, concat('task-', CAST(user_id AS STRING)) AS task_id, concat('0123456789abcdef', CAST(event_id % 3 AS STRING)) AS sha256, CAST(1 + event_id % 2 AS INT) AS attempt FROM {events}",
    "cleanup": "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'uploading' WHEN 1 THEN 'received' WHEN 2 THEN 'purge_failed' WHEN 3 THEN 'purging' ELSE 'purged' END AS status, ts AS cleanup_after, CAST(event_id % 3 AS INT) AS cleanup_attempts, event_id % 7 > 1 AS removed FROM {events}",
    "quota_items": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderkey % 5 = 0 AS quota_released FROM {orders}",
    "quota_users": "SELECT o_custkey AS user_id, CAST(max(o_orderdate) AS DATE) AS quota_date, CAST(1 + o_custkey % 3 AS BIGINT) AS quota_count, CAST(150000 AS BIGINT) AS quota_bytes FROM {orders} GROUP BY o_custkey",
    "submissions": "SELECT DISTINCT id, title, authors, reason, status, size_bytes, page_count, created_at, submitter_email, is_public, review_outcome, review_summary, review_published, review_published_at, terms_version, terms_locale, terms_notice_sha256, terms_accepted_at FROM {research_submissions}",
    "assets": "SELECT DISTINCT id, task_id, role, sha256, size_bytes AS bytes, page_count AS pages, CAST(coalesce(page_count, 0) * 2500 AS BIGINT) AS characters, CASE WHEN id < '8' THEN 'active' ELSE 'purged' END AS retention_state FROM {document_assets}",
    "urls": """SELECT CAST(n_nationkey AS INT) AS id, CASE n_nationkey WHEN 0 THEN 'https://journals.example.org/a.pdf?x=1' WHEN 1 THEN 'http://10.1.2.3/a' WHEN 2 THEN 'http://2130706433/' WHEN 3 THEN 'http://0x7f.1/' WHEN 4 THEN 'http://[::ffff:10.0.0.1]/' WHEN 5 THEN 'http://[::]/' WHEN 6 THEN 'http://198.18.0.1/'
     WHEN 7 THEN 'http://93.184.216.34:8080/x' WHEN 8 THEN 'http://user:pw@example.org/' WHEN 9 THEN 'ftp://example.org/a' WHEN 10 THEN 'https://[2606:2800:220:1:248:1893:25c8:1946]/' WHEN 11 THEN 'https://[fe80::1]/' WHEN 12 THEN 'http://localhost/' WHEN 13 THEN 'http://100.64.0.9/' WHEN 14 THEN 'http://172.32.0.1/'
     WHEN 15 THEN 'http://256.1.1.1/' WHEN 16 THEN 'https://müller.example/' WHEN 17 THEN 'http://192.168.0.1.example.com/' WHEN 18 THEN 'http://[2001:db8::5]/' WHEN 19 THEN 'http://169.254.169.254/latest' WHEN 20 THEN 'HTTPS://EXAMPLE.ORG' WHEN 21 THEN 'http:///nothing' WHEN 22 THEN 'http://[::1]:80/' WHEN 23 THEN 'http://224.0.0.1/' ELSE 'not a url' END AS url FROM {nation}""",
    "references": "SELECT concat('ref-', CAST(p_partkey AS STRING)) AS reference_id, CASE WHEN p_partkey % 4 = 0 THEN concat('https://doi.org/10.5555/P', CAST(p_partkey AS STRING)) END AS doi, concat('Smith J. Study of ', p_name, ' under load ', CAST(p_partkey AS STRING)) AS raw_citation, CASE WHEN p_partkey % 3 > 0 THEN concat('Study of ', p_name, ' under load ', CAST(p_partkey AS STRING)) END AS title, CASE WHEN p_partkey % 5 > 0 THEN '1999' END AS year, p_brand AS venue FROM {part}",
    "answers": """SELECT concat('ref-', CAST(p_partkey AS STRING)) AS reference_id, CASE WHEN p_partkey % 11 = 0 THEN 503 ELSE 200 END AS status,
     CASE WHEN p_partkey % 4 = 0 THEN concat('{{"message":{{"DOI":"10.5555/P', CAST(p_partkey AS STRING), '","title":["Study of ', p_name, ' under load ', CAST(p_partkey AS STRING), '"],"author":[{{"given":"Ann","family":"Smith"}}],"published":{{"date-parts":[[2001,2]]}},"container-title":["Journal ', p_brand, '"]}}}}')
     ELSE concat('{{"message":{{"items":[{{"DOI":"10.5555/s', CAST(p_partkey AS STRING), '","title":["', CASE WHEN p_partkey % 13 = 0 THEN 'Something else entirely here' ELSE concat('Study of ', p_name, ' under load ', CAST(p_partkey AS STRING)) END, '"],"author":[{{"given":"Jo","family":"', CASE WHEN p_partkey % 17 = 0 THEN 'Other' ELSE 'Smith' END, '"}}],"published-print":{{"date-parts":[[', CASE WHEN p_partkey % 19 = 0 THEN '2005' ELSE '1999' END, ']]}},"score":', CASE WHEN p_partkey % 7 = 0 THEN '29.9' ELSE '31.5' END, '}}]}}}}') END AS body FROM {part}""",
    "open_access": """SELECT CASE WHEN p_partkey % 4 = 0 THEN concat('10.5555/p', CAST(p_partkey AS STRING)) ELSE concat('10.5555/s', CAST(p_partkey AS STRING)) END AS doi, CASE WHEN p_partkey % 23 = 0 THEN 404 ELSE 200 END AS status,
     concat('{{"open_access":{{"is_oa":', CASE WHEN p_size % 3 = 0 THEN 'false' ELSE 'true' END, '}},"best_oa_location":', CASE WHEN p_size % 2 = 0 THEN '{{"pdf_url":"https://oa.example.org/best.pdf"}}' ELSE 'null' END, ',"locations":[{{"is_oa":false,"pdf_url":"https://x.example.org/no.pdf"}},{{"is_oa":true,"pdf_url":', CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '"https://oa.example.org/other.pdf"' END, '}}]}}') AS body FROM {part}""",
    "attempts": """SELECT s_suppkey AS fetch_id, CAST(h.r_regionkey AS INT) AS hop, CASE WHEN s_suppkey % 9 = 1 AND h.r_regionkey = 1 THEN 'http://10.0.0.5/a' ELSE concat('https://files.example.org/', CAST(s_suppkey AS STRING)) END AS url, CASE WHEN h.r_regionkey < s_suppkey % 4 THEN 302 WHEN s_suppkey % 9 = 2 THEN 404 ELSE 200 END AS status,
     CASE WHEN h.r_regionkey < s_suppkey % 4 THEN CASE WHEN s_suppkey % 9 = 3 THEN '' ELSE 'https://files.example.org/next' END END AS location, CASE WHEN s_suppkey % 9 = 4 THEN '192.168.1.1' ELSE '93.184.216.34' END AS address, CASE WHEN s_suppkey % 9 = 5 THEN CAST(52428801 AS BIGINT) ELSE CAST(1000 AS BIGINT) END AS declared_bytes, CAST(900 AS BIGINT) AS read_bytes,
     CASE WHEN s_suppkey % 9 = 6 THEN '<html>' ELSE '%PDF-1.7' END AS head, CASE WHEN s_suppkey % 9 = 7 THEN 501 ELSE 12 END AS pages FROM {supplier} CROSS JOIN {region} h WHERE h.r_regionkey <= s_suppkey % 4""",
    "steps": "SELECT user_id, event_id, ts, CASE event_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'validating' WHEN 2 THEN 'parsing' WHEN 3 THEN 'references_ready' WHEN 4 THEN 'checking' ELSE 'parsing_failed' END AS status FROM {events}",
    "pairs": "SELECT l_orderkey AS pair_id, CAST(l_linenumber * 100000 + l_suppkey AS INT) AS part_id, concat('Lead ', CAST(l_orderkey AS STRING), ' first. ', substring('a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5 b6 b7 b8 b9 c1 c2 c3 c4 c5 c6 c7 c8 c9', 1, CAST(3 * (9 + l_linenumber * 2) - 1 AS INT)), ' tail.') AS subject, concat('Other start, ', upper(substring('a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5 b6 b7 b8 b9 c1 c2 c3 c4 c5 c6 c7 c8 c9', 1, CAST(3 * (9 + l_linenumber * 2) - 1 AS INT))), '; end') AS source, l_linenumber FROM {lineitem}",
}


def _made(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = MADE[name]
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{d}/{n}.parquet") for n in names})


def _sql(name: str) -> str:
    text = MADE[name]
    return "(" + text.format(**{n: n for n in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))}) + ")"


def review_progress(spark: SparkSession, d: str) -> DataFrame:
    """Decided and all records of each task."""
    return workflow.completeness(_made(spark, d, "evidence"), _made(spark, d, "decisions").where("evidence_id is not null"))


def decision_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of every record after its latest decision."""
    e, dec = _made(spark, d, "evidence"), workflow.latest_decisions(_made(spark, d, "decisions").where("evidence_id is not null"))
    return e.join(dec.select("evidence_id", "decision"), "evidence_id", "left").select("evidence_id", F.col("decision"), workflow.status_after(F.col("decision")).alias("state"))


def report_versions(spark: SparkSession, d: str) -> DataFrame:
    """What a task's report is named by."""
    return workflow.report_version(_made(spark, d, "evidence"), _made(spark, d, "decisions").where("evidence_id is not null"))


def decision_summary(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of each task counted in the order of a report."""
    return workflow.rollup(_made(spark, d, "decisions"))


def report_records(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every task's report."""
    return workflow.report_lines(_made(spark, d, "evidence"), _made(spark, d, "decisions"))


def enqueued_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Requests that become jobs, each once."""
    r = _made(spark, d, "requests")
    running = r.where("request_no % 50 = 0").select("kind", "task_id", "sha256").distinct()
    return workflow.enqueue(r, running).select("job", "request_no")


def cleanup_batch(spark: SparkSession, d: str) -> DataFrame:
    """The hundred items longest due, leased and finished."""
    now = F.expr(NOW)
    claimed = workflow.claim_due(_made(spark, d, "cleanup"), now)
    return workflow.finish_cleanup(claimed, now).select("id", "status", "cleanup_after", "cleanup_attempts")


def quota_release(spark: SparkSession, d: str) -> DataFrame:
    """Users' counters after their purged items are taken off."""
    return workflow.release_quota(_made(spark, d, "quota_users"), _made(spark, d, "quota_items"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Valid sessions of one token."""
    c = table(spark, d, "customer", "c_custkey")
    s = c.select(F.sha2(F.concat(F.lit("token-"), (F.col("c_custkey") % 10).cast("string")), 256).alias("token_hash"), F.col("c_custkey").alias("user_id"), workflow.session_end(F.expr(f"{NOW} - make_interval(0, 0, 0, cast(c_custkey % 60 as int))"), public=True).alias("expires_at"))
    return workflow.valid_sessions(s, c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4 > 0).alias("active")), F.lit("token-3"), F.expr(NOW))


def checks_done(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's task has records of its present source."""
    p = table(spark, d, "parsed_documents", "task_id", "source_sha256", "parser_version").distinct().where("task_id is not null")
    v = p.select("task_id", F.concat_ws(":", "source_sha256", F.when(F.substr("task_id", F.lit(1), F.lit(1)) < "8", "document-rules/1.0").otherwise("older/0.9"), F.lit("x")).alias("evidence_version"), "source_sha256")
    return workflow.already_done(v, F.col("source_sha256"), "document-rules")


def submissions_own(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest of the largest domain's submitters, without reviews."""
    s = _made(spark, d, "submissions").where("status = 'received' and submitter_email like '%@%marvik%'")
    return s.orderBy(F.desc("created_at"), "id").limit(100).select("id", "title", "authors", "reason", "status", "size_bytes", "page_count", "created_at")


def submissions_published(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest public ones, without e-mail address and file."""
    return _made(spark, d, "submissions").where("status = 'received' and is_public").orderBy(F.desc("created_at"), "id").limit(100).select("id", "title", "authors", "reason", "created_at")


def submissions_notices(spark: SparkSession, d: str) -> DataFrame:
    """The hundred latest published reviews."""
    return _made(spark, d, "submissions").where("status <> 'purged' and review_published").orderBy(F.desc("review_published_at"), "id").limit(100).select("id", "title", "review_outcome", "review_summary", "review_published_at")


def submissions_reviewer(spark: SparkSession, d: str) -> DataFrame:
    """The two hundred newest with all that a reviewer sees."""
    return _made(spark, d, "submissions").where("status = 'received'").orderBy(F.desc("created_at"), "id").limit(200)


def publication_checks(spark: SparkSession, d: str) -> DataFrame:
    """First reason to refuse a publication; null where there is none."""
    s = _made(spark, d, "submissions")
    n = F.length(F.trim(F.coalesce("review_summary", F.lit(""))))
    reason = F.when(F.col("status") != "received", "not_found").when(~F.coalesce(F.col("review_outcome").isin(workflow.OUTCOMES), F.lit(False)), "outcome").when(F.col("review_published") & ~n.between(10, 2000), "summary")
    return s.select("id", reason.alias("refused"))


def public_urls(spark: SparkSession, d: str) -> DataFrame:
    """Which of many spellings of addresses may be fetched."""
    return _made(spark, d, "urls").select("id", lookup.public_url(F.col("url")).alias("public"))


def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of each guarded download."""
    return lookup.fetch_outcomes(_made(spark, d, "attempts").withColumn("addresses", F.array("address")))


def bibliographic_lookup(spark: SparkSession, d: str) -> DataFrame:
    """References after the answers of both services."""
    r = _made(spark, d, "references").withColumn("authors", F.when(F.expr("substr(reference_id, -1) <> '9'"), F.array(F.lit("Jo Smith"))).otherwise(F.array().cast("array<string>")))
    got = lookup.resolve(r, _made(spark, d, "answers"), _made(spark, d, "open_access"))
    return got.select("reference_id", "doi", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "metadata_status", "full_text_status", "access_url")


def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of each role's assets within a corpus budget, in order of their ids; what would exceed it is skipped."""
    a = _made(spark, d, "assets")
    return lookup.corpus_budget(a, "role", "id", items=60, bytes=60_000_000, pages=900, characters=3_000_000)


def index_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each task's assets in their order."""
    return lookup.index_digest(_made(spark, d, "assets").where("task_id is not null"), "task_id", "id", "id")


def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay in each role's size-bound index."""
    return lookup.within_index(_made(spark, d, "assets").where("bytes is not null"), "role", "id", "bytes", budget=50_000_000).select("role", "id", "index_bytes")


def full_text_reuse(spark: SparkSession, d: str) -> DataFrame:
    """References whose full text is held and active."""
    r = table(spark, d, "reference_sources", "id", "task_id").distinct()
    a = _made(spark, d, "assets")
    first = a.where("task_id is not null").groupBy("task_id").agg(F.min("id").alias("full_text_asset_id"))
    return lookup.reusable(r.join(first, "task_id", "left"), a).groupBy("reuse").agg(F.count("*").alias("n"), F.count("full_text_asset_id").alias("with_asset"))


def lifecycle_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps between the states of each user's run, and whether each is allowed."""
    from pyspark.sql import Window as W

    from docsieve.operators.review import allowed

    s = _made(spark, d, "steps").withColumn("before", F.lag("status").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("before is not null")
    return s.groupBy("before", "status", allowed(F.col("before"), F.col("status")).alias("allowed")).agg(F.count("*").alias("n"))


def pair_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Word runs that two texts share, the longest first."""
    p = _made(spark, d, "pairs").select("pair_id", "part_id", "subject", "source")
    return alignment.compare_texts(p, ["pair_id", "part_id"], "subject", "source").select("pair_id", "part_id", "place", "matched_words", "severity", F.round("confidence", 6).alias("confidence"), "subject_excerpt", "source_excerpt").distinct()


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_LATEST = f"SELECT evidence_id, decision_id, decision, reason FROM {_sql('decisions')} WHERE evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY created_at DESC, decision_id DESC) = 1"
_ALLOWED = "(before = 'created' AND status = 'validating') OR (before = 'validating' AND status = 'parsing') OR (before = 'parsing' AND status IN ('references_ready', 'parsing_failed')) OR (before = 'parsing_failed' AND status = 'parsing') OR (before = 'references_ready' AND status = 'checking')"
_K = "CAST(substr(reference_id, 5) AS BIGINT)"
SQL = {
    "review_progress": f"SELECT task_id, count(*) AS total, count(decision) AS decided, count(decision) = count(*) AS complete FROM {_sql('evidence')} LEFT JOIN ({_LATEST}) USING (evidence_id) GROUP BY 1",
    "decision_states": f"SELECT evidence_id, decision, CASE decision WHEN 'confirmed' THEN 'verified_anomaly' WHEN 'insufficient' THEN 'insufficient' WHEN 'reasonable' THEN 'reasonable' ELSE 'needs_review' END AS state FROM {_sql('evidence')} LEFT JOIN ({_LATEST}) USING (evidence_id)",
    "report_versions": f"""SELECT task_id, sha256(concat('[', string_agg(concat('["', evidence_id, '","', evidence_version, '",', coalesce(concat('"', CAST(decision_id AS STRING), '"'), 'null'), ']'), ',' ORDER BY created_at, evidence_id), ']')) AS version FROM {_sql('evidence')} LEFT JOIN ({_LATEST}) USING (evidence_id) GROUP BY 1""".replace("coalesce(concat('\"', CAST(decision_id AS STRING), '\"'), 'null')", "CASE WHEN decision_id IS NULL THEN 'null' ELSE concat('\"', decision_id, '\"') END"),
    "decision_summary": f"SELECT task_id, string_agg(concat(decision, ': ', n), '; ' ORDER BY CASE decision WHEN 'confirmed' THEN 0 WHEN 'needs_material' THEN 1 WHEN 'insufficient' THEN 2 ELSE 3 END) AS summary FROM (SELECT task_id, decision, count(*) AS n FROM {_sql('decisions')} GROUP BY 1, 2) GROUP BY 1",
    "report_records": f"""WITH bc AS (SELECT task_id, evidence_code AS code, decision AS dc, reason AS rc FROM {_sql('decisions')} QUALIFY row_number() OVER (PARTITION BY task_id, evidence_code ORDER BY created_at DESC, decision_id DESC) = 1)
 SELECT e.task_id, CAST(row_number() OVER (PARTITION BY e.task_id ORDER BY severity DESC, created_at, evidence_id) AS INT) AS line, e.code, coalesce(l.decision, dc) AS decision, concat(e.code, ', page ', coalesce(CAST(page AS STRING), 'unknown'), ', confidence ', format('{{:.2f}}', confidence), CASE WHEN coalesce(l.decision, dc) IS NULL THEN '' ELSE concat(', decided ', coalesce(l.decision, dc), ': ', replace(replace(replace(coalesce(l.reason, rc), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) END) AS text FROM {_sql('evidence')} e LEFT JOIN ({_LATEST}) l USING (evidence_id) LEFT JOIN bc ON bc.task_id = e.task_id AND bc.code = e.code""",
    "enqueued_jobs": f"WITH r AS (SELECT * FROM {_sql('requests')}) SELECT concat(kind, ':', task_id, ':', left(sha256, 16), ':', attempt) AS job, min(request_no) AS request_no FROM r WHERE (kind, task_id, sha256) NOT IN (SELECT (kind, task_id, sha256) FROM r WHERE request_no % 50 = 0) GROUP BY 1",
    "cleanup_batch": f"SELECT id, CASE WHEN removed THEN 'purged' ELSE 'purge_failed' END AS status, CASE WHEN NOT removed THEN {NOW} + INTERVAL 15 MINUTE END AS cleanup_after, CAST(cleanup_attempts + CASE WHEN removed THEN 0 ELSE 1 END AS INT) AS cleanup_attempts FROM (SELECT * FROM {_sql('cleanup')} WHERE status IN ('uploading', 'purge_failed', 'purging') AND cleanup_after <= {NOW} ORDER BY cleanup_after, id LIMIT 100)",
    "quota_release": f"SELECT u.user_id, quota_date, greatest(0, quota_count - coalesce(n, 0)) AS quota_count, CAST(greatest(0, quota_bytes - coalesce(s, 0)) AS BIGINT) AS quota_bytes FROM {_sql('quota_users')} u LEFT JOIN (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n, sum(size_bytes) AS s FROM {_sql('quota_items')} WHERE NOT quota_released GROUP BY 1, 2) i ON i.user_id = u.user_id AND i.day = u.quota_date",
    "sessions": f"SELECT c_custkey AS user_id, {NOW} - CAST(c_custkey % 60 AS INT) * INTERVAL 1 DAY + INTERVAL 30 DAY AS expires_at FROM customer WHERE c_custkey % 10 = 3 AND c_custkey % 4 > 0 AND c_custkey % 60 < 30",
    "checks_done": "SELECT task_id, bool_or(task_id < '8') AS done FROM (SELECT DISTINCT task_id, source_sha256 FROM parsed_documents WHERE task_id IS NOT NULL) GROUP BY 1",
    "submissions_own": f"SELECT id, title, authors, reason, status, size_bytes, page_count, created_at FROM {_sql('submissions')} WHERE status = 'received' AND submitter_email LIKE '%@%marvik%' ORDER BY created_at DESC, id LIMIT 100",
    "submissions_published": f"SELECT id, title, authors, reason, created_at FROM {_sql('submissions')} WHERE status = 'received' AND is_public ORDER BY created_at DESC, id LIMIT 100",
    "submissions_notices": f"SELECT id, title, review_outcome, review_summary, review_published_at FROM {_sql('submissions')} WHERE status <> 'purged' AND review_published ORDER BY review_published_at DESC NULLS LAST, id LIMIT 100",
    "submissions_reviewer": f"SELECT * FROM {_sql('submissions')} WHERE status = 'received' ORDER BY created_at DESC, id LIMIT 200",
    "publication_checks": f"SELECT id, CASE WHEN status <> 'received' THEN 'not_found' WHEN review_outcome IS NULL OR review_outcome NOT IN ('needs_further_review', 'insufficient_evidence', 'no_issue_identified') THEN 'outcome' WHEN review_published AND length(trim(coalesce(review_summary, ''))) NOT BETWEEN 10 AND 2000 THEN 'summary' END AS refused FROM {_sql('submissions')}",
    "public_urls": "SELECT CAST(n_nationkey AS INT) AS id, n_nationkey IN (0, 7, 10, 14, 16, 17, 20) AS public FROM nation",
    "fetch_outcomes": "SELECT s_suppkey AS fetch_id, CASE WHEN s_suppkey % 9 = 4 THEN 'blocked_address' WHEN s_suppkey % 9 = 1 AND s_suppkey % 4 >= 1 THEN 'blocked_address' WHEN s_suppkey % 9 = 3 AND s_suppkey % 4 > 0 THEN 'redirect_without_target' WHEN s_suppkey % 9 = 2 THEN 'http_error' WHEN s_suppkey % 9 = 5 THEN 'too_large' WHEN s_suppkey % 9 = 6 THEN 'not_pdf' WHEN s_suppkey % 9 = 7 THEN 'too_many_pages' ELSE 'obtained' END AS outcome, s_suppkey % 4 + 1 AS hops FROM supplier",
    "bibliographic_lookup": f"""WITH r AS (SELECT *, {_K} AS k, CASE WHEN right(reference_id, 1) <> '9' THEN 'Jo Smith' ELSE '' END AS authors FROM {_sql('references')}),
 m AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'lookup_failed' WHEN k % 4 > 0 AND (k % 7 = 0 OR k % 13 = 0 OR (title IS NOT NULL AND k < 100) OR (k % 19 = 0 AND year IS NOT NULL) OR (k % 17 = 0 AND authors <> '') OR (title IS NULL AND NOT (k % 19 > 0 AND year IS NOT NULL) AND NOT (k % 17 > 0 AND authors <> ''))) THEN 'ambiguous' ELSE 'resolved' END AS metadata_status FROM r),
 n AS (SELECT m.*, p_size, p_brand, metadata_status = 'resolved' AS ok, CASE WHEN k % 4 = 0 THEN concat('10.5555/p', k) ELSE concat('10.5555/s', k) END AS found FROM m JOIN part ON p_partkey = k),
 f AS (SELECT *, CASE WHEN NOT ok THEN 'metadata_unavailable' WHEN k % 23 = 0 THEN 'oa_lookup_failed' WHEN p_size % 3 > 0 AND (p_size % 2 = 0 OR p_size % 5 > 0) THEN 'available' ELSE 'not_open_access' END AS full_text_status FROM n)
 SELECT reference_id, CASE WHEN ok THEN found ELSE doi END AS doi, CASE WHEN ok THEN replace(raw_citation, 'Smith J. ', '') ELSE title END AS title, CASE WHEN ok THEN CASE WHEN k % 4 = 0 THEN 'Ann Smith' WHEN k % 17 = 0 THEN 'Jo Other' ELSE 'Jo Smith' END ELSE authors END AS authors, CASE WHEN ok THEN CASE WHEN k % 4 = 0 THEN '2001' WHEN k % 19 = 0 THEN '2005' ELSE '1999' END ELSE year END AS year, CASE WHEN ok AND k % 4 = 0 THEN concat('Journal ', p_brand) ELSE venue END AS venue, metadata_status, full_text_status, CASE WHEN full_text_status = 'available' THEN CASE WHEN p_size % 2 = 0 THEN 'https://oa.example.org/best.pdf' ELSE 'https://oa.example.org/other.pdf' END END AS access_url FROM f""",
    "corpus_totals": f"""WITH RECURSIVE a AS (SELECT role, id, coalesce(bytes, 0) AS b, coalesce(pages, 0) AS p, coalesce(characters, 0) AS c, row_number() OVER (PARTITION BY role ORDER BY id) AS i FROM {_sql('assets')}),
 f AS (SELECT role, CAST(0 AS BIGINT) AS i, CAST(NULL AS STRING) AS id, false AS taken, CAST(0 AS BIGINT) AS documents, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS pages, CAST(0 AS BIGINT) AS characters FROM a GROUP BY role
  UNION ALL SELECT a.role, a.i, a.id, ok, f.documents + CAST(ok AS BIGINT), f.bytes + CASE WHEN ok THEN b ELSE 0 END, f.pages + CASE WHEN ok THEN p ELSE 0 END, f.characters + CASE WHEN ok THEN c ELSE 0 END
  FROM f JOIN (SELECT * FROM a) a ON a.role IS NOT DISTINCT FROM f.role AND a.i = f.i + 1, LATERAL (SELECT NOT (f.documents >= 60 OR f.bytes + b > 60000000 OR f.pages + p > 900 OR f.characters + c > 3000000) AS ok))
 SELECT role, id, taken, documents, bytes, pages, characters FROM f WHERE i > 0""",
    "index_digests": f"SELECT task_id, sha256(string_agg(id, '|' ORDER BY id)) AS digest FROM {_sql('assets')} WHERE task_id IS NOT NULL GROUP BY 1",
    "index_documents": f"SELECT role, id, index_bytes FROM (SELECT role, id, CAST(sum(bytes) OVER (PARTITION BY role ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS index_bytes FROM {_sql('assets')} WHERE bytes IS NOT NULL) WHERE index_bytes <= 50000000",
    "full_text_reuse": f"WITH a AS (SELECT * FROM {_sql('assets')}), f AS (SELECT task_id, min(id) AS x FROM a WHERE task_id IS NOT NULL GROUP BY 1) SELECT coalesce(s.retention_state = 'active', false) AS reuse, count(*) AS n, count(x) AS with_asset FROM (SELECT DISTINCT id, task_id FROM reference_sources) r LEFT JOIN f USING (task_id) LEFT JOIN (SELECT DISTINCT id, retention_state FROM a) s ON s.id = f.x GROUP BY 1",
    "lifecycle_steps": f"SELECT before, status, {_ALLOWED} AS allowed, count(*) AS n FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {_sql('steps')}) WHERE before IS NOT NULL GROUP BY 1, 2, 3",
    "pair_comparison": f"SELECT DISTINCT pair_id, part_id, 1 AS place, CAST(9 + l_linenumber * 2 AS INT) AS matched_words, CASE WHEN 9 + l_linenumber * 2 >= 25 THEN 'high' ELSE 'medium' END AS severity, round(least(0.99, 0.65 + (9 + l_linenumber * 2) / 100.0), 6)::DOUBLE AS confidence, substring(subject, CAST(strpos(subject, 'a1') AS BIGINT), CAST(3 * (9 + l_linenumber * 2) - 1 AS BIGINT)) AS subject_excerpt, substring(source, CAST(strpos(source, 'A1') AS BIGINT), CAST(3 * (9 + l_linenumber * 2) - 1 AS BIGINT)) AS source_excerpt FROM {_sql('pairs')} WHERE 9 + l_linenumber * 2 >= 12",
}
