"""Relational queries of the review workflow's data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import images, lookup, review
from docsieve.sources.tables import table
from docsieve.streaming import limits


def tile_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = images.signatures(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return s.select("vec_id", images.ones("sig").alias("ones"), F.round("minority", 6).alias("minority"), F.round("variance", 6).alias("variance"))


def duplicate_assets(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "document_assets", "id", "sha256", "created_at").where("sha256 is not null").distinct()
    return images.later_duplicates(a, "sha256", ["created_at"], "id")


def metadata_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_sources", "id", "full_text_status", "metadata_status").distinct()
    return r.where("full_text_status <> 'obtained'").groupBy("full_text_status", "metadata_status").agg(F.count("*").alias("n"))


def parse_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_sources", "id", "task_id", "parse_status", "confidence", "title", "year", "page").distinct()
    return r.groupBy("task_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("parse_status") == "parsed").alias("parsed"), F.count_if(F.col("parse_status") == "failed").alias("failed"),
        F.count("page").alias("located"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def parse_status_rule(spark: SparkSession, d: str) -> DataFrame:
    """Status and confidence derived from the fields, against the stored ones."""
    r = table(spark, d, "reference_sources", "id", "title", "authors", "year", "parse_status").distinct()
    usable = F.coalesce(F.col("title") != "", F.lit(False)) | (F.coalesce(F.size("authors") > 0, F.lit(False)) & F.col("year").isNotNull())
    derived = F.when(usable, "parsed").otherwise("failed")
    return r.groupBy(derived.alias("derived"), "parse_status").agg(F.count("*").alias("n"))


def doi_normal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reference_sources", "id", "doi").where("doi is not null").select("id", T.doi(F.col("doi")).alias("doi")).distinct()


def author_families(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_sources", F.explode("authors").alias("name")).where("trim(name) <> ''")
    family = F.lower(F.element_at(F.split(F.trim("name"), r"\s+"), -1))
    return r.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


def url_checks(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_sources", "id", "access_url").where("access_url is not null").distinct()
    return r.select("id", lookup.public_url(F.col("access_url")).alias("public"), F.regexp_replace("access_url", r"[?#].*$", "").alias("bare_url"))


def metadata_match(spark: SparkSession, d: str) -> DataFrame:
    """References and catalogue records that a lookup would take for the same: title, year and families, as far as both state them.

    A record's title must be covered by four fifths, so a reference holds one of
    its rarest fifth and one words; only those are joined.
    """
    refs = table(spark, d, "reference_sources", "id", "title", "raw_citation", "authors", "year").distinct()
    works = table(spark, d, "catalog_works", "work_id", "title", "creators", "pub_year")
    mine = F.array_distinct(T.words(F.coalesce(F.nullif(F.trim("title"), F.lit("")), "raw_citation", F.lit(""))))
    theirs = F.array_distinct(F.filter(T.words(F.coalesce("title", F.lit(""))), lambda w: F.length(w) >= 3))
    r, c = refs.withColumn("_w", mine), works.withColumn("_w", theirs).where("size(_w) >= 3")
    df = c.select(F.explode("_w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = c.select("work_id", F.size("_w").alias("n"), F.explode("_w").alias("word")).join(df, "word").groupBy("work_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("_k"))
    keys = ranked.select("work_id", F.explode(F.slice("_k", F.lit(1), F.expr("n - cast(ceil(0.8 * n) as int) + 1"))).alias("k")).select("work_id", F.col("k.word").alias("word"))
    words = r.select("id", "_w", F.explode("_w").alias("word")).join(keys, "word").select("id", "work_id").distinct()
    families = F.transform(F.filter(F.split(F.coalesce("creators", F.lit("")), ";"), lambda a: F.trim(a) != ""), lambda a: F.struct(F.lit(None).cast("string").alias("given"), lookup.family(a).alias("family")))
    candidate = works.select("work_id", F.struct(F.array("title").alias("title"), families.alias("author"), F.struct(F.array(F.array(F.col("pub_year"))).alias("date-parts")).alias("published"), F.lit(None).cast("struct<`date-parts`:array<array<int>>>").alias("published-print")).alias("_c"))
    both = words.join(refs, "id").join(candidate, "work_id")
    return both.where(lookup.candidate_matches({k: F.col(k) for k in ("title", "raw_citation", "authors", "year")}, F.col("_c"))).select("id", "work_id").distinct()


def latest_decision(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    return review.latest(e, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


def newest_100(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "research_submissions", "id", "title", "created_at").distinct()
    return s.orderBy(F.desc("created_at"), "id").limit(100)


def public_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Published submissions without e-mail address and file."""
    s = table(spark, d, "research_submissions", "id", "title", "review_outcome", "review_summary", "review_published", "is_public").distinct()
    return s.where("is_public and review_published").select("id", "title", "review_outcome", "review_summary")


def submission_checks(spark: SparkSession, d: str) -> DataFrame:
    """First reason to reject a submission; null where there is none."""
    s = table(spark, d, "research_submissions", "id", "title", "reason", "submitter_email", "size_bytes", "page_count").distinct()
    reason = (
        F.when(F.coalesce(F.length(F.trim("title")), F.lit(0)).between(2, 500) == False, "title")  # noqa: E712
        .when(F.coalesce(F.length(F.trim("reason")), F.lit(0)).between(10, 4000) == False, "reason")  # noqa: E712
        .when(~F.coalesce(F.lower(F.trim("submitter_email")).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length("submitter_email") <= 254), F.lit(False)), "email")
        .when(F.coalesce(F.col("size_bytes"), F.lit(0)) > 52_428_800, "size").when(F.coalesce(F.col("page_count"), F.lit(0)) > 500, "pages")
    )
    return s.select("id", reason.alias("reject_reason"))


def fk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every task with its source file, parsed document and number of references."""
    t = table(spark, d, "paper_tasks", "id", "status", "source_file_id").distinct()
    a = table(spark, d, "document_assets", F.col("id").alias("source_file_id"), "sha256", "page_count").distinct()
    p = table(spark, d, "parsed_documents", F.col("task_id").alias("id"), F.col("id").alias("document_id")).distinct().groupBy("id").agg(F.count("*").alias("documents"))
    r = table(spark, d, "reference_sources", F.col("task_id").alias("id"), F.col("id").alias("r")).distinct().groupBy("id").agg(F.count("*").alias("refs"))
    j = t.join(a, "source_file_id", "left").join(p, "id", "left").join(r, "id", "left")
    return j.select("id", "status", "sha256", "page_count", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), F.coalesce("refs", F.lit(0).cast("bigint")).alias("refs"))


def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    """Parsed documents whose source hash is or isn't that of their asset."""
    p = table(spark, d, "parsed_documents", F.col("id").alias("document_id"), F.col("asset_id").alias("id"), "source_sha256").distinct()
    a = table(spark, d, "document_assets", "id", "sha256").distinct()
    return p.join(a, "id", "left").select("document_id", F.coalesce(F.col("source_sha256") == F.col("sha256"), F.lit(False)).alias("current"))


def backfill_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the name of their nation, a default where there is none."""
    s, n = table(spark, d, "supplier", "s_suppkey", "s_nationkey"), table(spark, d, "nation", "n_nationkey", "n_name")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    """Assets of temporary roles and the state they go to."""
    a = table(spark, d, "document_assets", "id", "task_id", "role").distinct().withColumn("retention_state", F.lit("active"))
    return review.purge(a, ["source_pdf", "reference_pdf", "cited_full_text", "index"]).select("id", "role", "retention_state")


def purged_references(spark: SparkSession, d: str) -> DataFrame:
    """References of tasks whose assets are purged (semi-join)."""
    gone = retention_purge(spark, d).select(F.col("id").alias("asset_id"))
    docs = table(spark, d, "parsed_documents", "asset_id", "task_id").distinct().join(gone, "asset_id", "left_semi").select("task_id")
    return table(spark, d, "reference_sources", "id", "task_id").distinct().join(docs, "task_id", "left_semi").groupBy("task_id").agg(F.count("*").alias("refs"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Line items of each order up to a total quantity of 100."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    return review.prefix_budget(li, "l_orderkey", ["l_linenumber", "q"], F.col("q"), 100).select("l_orderkey", "l_linenumber", "running")


def budget_skip_fold(spark: SparkSession, d: str) -> DataFrame:
    """Assets of a task in order of arrival within a page budget of 300; one that overflows is skipped."""
    a = table(spark, d, "document_assets", "id", "task_id", "page_count").distinct()
    return review.skipping_budget(a, "task_id", "id", "page_count", 300)


def fingerprint_classes(spark: SparkSession, d: str) -> DataFrame:
    """How many references fall on one fingerprint of their fields; class sizes only."""
    r = table(spark, d, "reference_sources", "id", "raw_citation", "title", "venue", "year").distinct()
    f = r.select(review.fingerprint(F.col("raw_citation"), F.col("title"), F.col("venue"), F.col("year")).alias("f"))
    return f.groupBy("f").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("classes"))


def status_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every status with whether it can go on to checking."""
    t = table(spark, d, "paper_tasks", "id", "status").distinct()
    return t.groupBy("status").agg(F.count("*").alias("n")).withColumn("may_check", review.allowed(F.col("status"), F.lit("checking")))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """At most 3 admitted events in 10 minutes for each user; denied ones don't count."""
    return limits.admissions(table(spark, d, "events", "user_id", "event_id", "ts"), "user_id", "ts", "event_id", limit=3, seconds=600.0)


def failure_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_id", "ts", "event_type").where("event_type = 'error'")
    return limits.failure_windows(e, "user_id", "ts", "event_id", most=2, seconds=86_400.0)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return limits.windowed_counts(table(spark, d, "events", "ts", "event_type"), every="1 day")


def run_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_id", "ts")
    return limits.attempts(e, "user_id", ["ts", "event_id"]).groupBy("user_id").agg(F.max("attempt").alias("attempts"))


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Report lines of each task: counts of references per status, in fixed order."""
    r = table(spark, d, "reference_sources", "id", "task_id", "parse_status").distinct()
    n = r.groupBy("task_id", "parse_status").agg(F.count("*").alias("n"))
    return n.withColumn("line", F.row_number().over(W.partitionBy("task_id").orderBy("parse_status"))).select("task_id", "line", F.concat_ws(": ", "parse_status", F.col("n").cast("string")).alias("text"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "tile_signatures": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, list_sum(v) / len(v) AS m FROM v), o AS (SELECT vec_id, v, m, len(list_filter(v, lambda x: x >= m)) AS ones FROM m) SELECT vec_id, CAST(ones AS INTEGER) AS ones, round(least(ones, len(v) - ones) / len(v), 6) AS minority, round(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v), 6) AS variance FROM o",
    "duplicate_assets": "SELECT id, first_id FROM (SELECT id, first_value(id) OVER w AS first_id, row_number() OVER w AS rn FROM (SELECT DISTINCT id, sha256, created_at FROM document_assets WHERE sha256 IS NOT NULL) WINDOW w AS (PARTITION BY sha256 ORDER BY created_at, id)) WHERE rn > 1",
    "metadata_status_histogram": "SELECT full_text_status, metadata_status, count(*) AS n FROM (SELECT DISTINCT id, full_text_status, metadata_status FROM reference_sources) WHERE full_text_status <> 'obtained' GROUP BY 1, 2",
    "parse_coverage": "SELECT task_id, count(*) AS total, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'failed') AS failed, count(page) AS located, round(avg(confidence), 6) AS mean_confidence FROM (SELECT DISTINCT id, task_id, parse_status, confidence, title, year, page FROM reference_sources) GROUP BY 1",
    "parse_status_rule": "SELECT CASE WHEN coalesce(title <> '', false) OR (coalesce(len(authors) > 0, false) AND year IS NOT NULL) THEN 'parsed' ELSE 'failed' END AS derived, parse_status, count(*) AS n FROM (SELECT DISTINCT id, title, authors, year, parse_status FROM reference_sources) GROUP BY 1, 2",
    "doi_normal": r"SELECT DISTINCT id, nullif(lower(regexp_replace(trim(doi), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '', 'i')), '') AS doi FROM reference_sources WHERE doi IS NOT NULL",
    "author_families": r"SELECT lower(regexp_split_to_array(trim(name), '\s+')[-1]) AS family, count(*) AS n FROM (SELECT unnest(authors) AS name FROM reference_sources) WHERE trim(name) <> '' GROUP BY 1",
    "url_checks": r"SELECT DISTINCT id, regexp_matches(access_url, '^(?i:https?)://[^@/?#]+(?:[/?#]|$)') AND NOT regexp_matches(access_url, '^[a-zA-Z]+://(?:10\.|127\.|0\.|169\.254\.|192\.168\.|localhost[:/?#]?|172\.(?:1[6-9]|2\d|3[01])\.)') AS public, regexp_replace(access_url, '[?#].*$', '') AS bare_url FROM reference_sources WHERE access_url IS NOT NULL",
    "metadata_match": r"""WITH l AS (SELECT id, nullif(trim(title), '') AS stated, list_distinct(regexp_extract_all(lower(coalesce(nullif(trim(title), ''), raw_citation, '')), '[\p{L}\p{N}_''-]+')) AS w, nullif(year, '') AS year, list_transform(list_filter(coalesce(authors, []), lambda a: trim(a) <> ''), lambda a: lower(regexp_split_to_array(trim(a), '\s+')[-1])) AS f FROM (SELECT DISTINCT id, title, raw_citation, authors, year FROM reference_sources)),
 r AS (SELECT work_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}_''-]+')), lambda x: length(x) >= 3) AS w, CAST(pub_year AS STRING) AS year, list_transform(list_filter(string_split(coalesce(creators, ''), ';'), lambda a: trim(a) <> ''), lambda a: lower(regexp_split_to_array(trim(a), '\s+')[-1])) AS f FROM catalog_works),
 o AS (SELECT id, work_id, count(*) AS n FROM (SELECT id, unnest(w) AS t FROM l) JOIN (SELECT work_id, unnest(w) AS t FROM r WHERE len(w) >= 3) USING (t) GROUP BY 1, 2)
 SELECT DISTINCT id, work_id FROM o JOIN l USING (id) JOIN r USING (work_id) WHERE n / len(r.w) >= 0.8 AND (stated IS NULL OR n / len(l.w) >= 0.8) AND coalesce(l.year = r.year, true) AND (len(l.f) = 0 OR len(r.f) = 0 OR list_has_any(l.f, r.f)) AND (stated IS NOT NULL OR coalesce(l.year = r.year, false) OR list_has_any(l.f, r.f))""",
    "latest_decision": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "newest_100": "SELECT DISTINCT id, title, created_at FROM research_submissions ORDER BY created_at DESC, id LIMIT 100",
    "public_submissions": "SELECT id, title, review_outcome, review_summary FROM (SELECT DISTINCT id, title, review_outcome, review_summary, review_published, is_public FROM research_submissions) WHERE is_public AND review_published",
    "submission_checks": r"SELECT id, CASE WHEN coalesce(length(trim(title)), 0) NOT BETWEEN 2 AND 500 THEN 'title' WHEN coalesce(length(trim(reason)), 0) NOT BETWEEN 10 AND 4000 THEN 'reason' WHEN NOT coalesce(regexp_full_match(lower(trim(submitter_email)), '[^@\s]+@[^@\s]+\.[^@\s]+') AND length(submitter_email) <= 254, false) THEN 'email' WHEN coalesce(size_bytes, 0) > 52428800 THEN 'size' WHEN coalesce(page_count, 0) > 500 THEN 'pages' END AS reject_reason FROM (SELECT DISTINCT id, title, reason, submitter_email, size_bytes, page_count FROM research_submissions)",
    "fk_lookup": "SELECT t.id, t.status, a.sha256, a.page_count, coalesce(p.n, 0) AS documents, coalesce(r.n, 0) AS refs FROM (SELECT DISTINCT id, status, source_file_id FROM paper_tasks) t LEFT JOIN (SELECT DISTINCT id, sha256, page_count FROM document_assets) a ON a.id = t.source_file_id LEFT JOIN (SELECT task_id, count(*) AS n FROM (SELECT DISTINCT task_id, id FROM parsed_documents) GROUP BY 1) p ON p.task_id = t.id LEFT JOIN (SELECT task_id, count(*) AS n FROM (SELECT DISTINCT task_id, id FROM reference_sources) GROUP BY 1) r ON r.task_id = t.id",
    "stale_sources": "SELECT p.id AS document_id, coalesce(p.source_sha256 = a.sha256, false) AS current FROM (SELECT DISTINCT id, asset_id, source_sha256 FROM parsed_documents) p LEFT JOIN (SELECT DISTINCT id, sha256 FROM document_assets) a ON a.id = p.asset_id",
    "backfill_join": "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "retention_purge": "SELECT DISTINCT id, role, 'purged' AS retention_state FROM document_assets WHERE role IN ('source_pdf', 'reference_pdf', 'cited_full_text', 'index')",
    "purged_references": "SELECT task_id, count(*) AS refs FROM (SELECT DISTINCT id, task_id FROM reference_sources) WHERE task_id IN (SELECT task_id FROM parsed_documents WHERE asset_id IN (SELECT id FROM document_assets WHERE role IN ('source_pdf', 'reference_pdf', 'cited_full_text', 'index'))) GROUP BY 1",
    "budget_prefix": "SELECT l_orderkey, l_linenumber, running FROM (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM lineitem) WHERE running <= 100",
    "fingerprint_classes": "SELECT size, count(*) AS classes FROM (SELECT count(*) AS size FROM (SELECT DISTINCT id, raw_citation, title, venue, year FROM reference_sources) GROUP BY raw_citation, title, venue, year) GROUP BY 1",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 f AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS log, false AS admitted FROM events GROUP BY user_id
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN len(list_filter(f.log, lambda x: e.t - x < 600000000)) < 3 THEN list_append(list_filter(f.log, lambda x: e.t - x < 600000000), e.t) ELSE list_filter(f.log, lambda x: e.t - x < 600000000) END, len(list_filter(f.log, lambda x: e.t - x < 600000000)) < 3 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, event_id, admitted FROM f WHERE i > 0""",
    "failure_windows": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
 f AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS opened, CAST(0 AS BIGINT) AS t, CAST(0 AS INT) AS failures FROM e GROUP BY user_id
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN f.opened IS NULL OR e.t - f.opened >= 86400000000 THEN e.t ELSE f.opened END, e.t, CAST(CASE WHEN f.opened IS NULL OR e.t - f.opened >= 86400000000 THEN 1 ELSE f.failures + 1 END AS INT) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, event_id, failures, failures >= 2 AS blocked, CAST(CASE WHEN failures >= 2 THEN greatest(1, ceil((opened + 86400000000 - t) / 1000000.0)) ELSE 0 END AS INT) AS retry_after FROM f WHERE i > 0""",
    "budget_skip_fold": """WITH RECURSIVE a AS (SELECT task_id, id, CAST(coalesce(page_count, 0) AS BIGINT) AS s, row_number() OVER (PARTITION BY task_id ORDER BY id) AS i FROM (SELECT DISTINCT id, task_id, page_count FROM document_assets)),
 f AS (SELECT task_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS STRING) AS id, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS used, false AS taken FROM a GROUP BY task_id
  UNION ALL SELECT a.task_id, a.i, a.id, a.s, CASE WHEN f.used + a.s > 300 THEN f.used ELSE f.used + a.s END, f.used + a.s <= 300 FROM f JOIN a ON a.task_id IS NOT DISTINCT FROM f.task_id AND a.i = f.i + 1)
 SELECT task_id, id, s AS page_count FROM f WHERE taken""",
    "status_paths": "SELECT status, count(*) AS n, status IN ('references_ready', 'indexing', 'checking_failed', 'review_ready') AS may_check FROM (SELECT DISTINCT id, status FROM paper_tasks) GROUP BY 1",
    "event_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "run_attempts": "SELECT user_id, CAST(count(*) AS INTEGER) AS attempts FROM events GROUP BY 1",
    "report_rows": "SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY parse_status) AS INTEGER) AS line, concat_ws(': ', parse_status, CAST(n AS VARCHAR)) AS text FROM (SELECT task_id, parse_status, count(*) AS n FROM (SELECT DISTINCT id, task_id, parse_status FROM reference_sources) GROUP BY 1, 2)",
}
