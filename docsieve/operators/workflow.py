"""The review workflow: queue, leases, sessions, quotas, decisions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the result contract: decisions in the order of a report, outcomes of a published review.
DECISIONS = ["confirmed", "needs_material", "insufficient", "reasonable"]
OUTCOMES = ["needs_further_review", "insufficient_evidence", "no_issue_identified"]
CLEANUP = ["uploading", "purge_failed", "purging"]
LEASE = "interval 15 minutes"


def job_key(kind: Column, task: Column, sha256: Column, attempt: Column) -> Column:
    """The deterministic name of a job: kind, task, the first 16 places of the source's hash and the attempt."""
    return F.concat_ws(":", kind, task, F.left(sha256, F.lit(16)), attempt.cast("string"))


def enqueue(requests: DataFrame, running: DataFrame) -> DataFrame:
    """Requests that become jobs: not those whose task already runs for the same hash, and of equal ones the first.

    requests: (request_no, kind, task_id, sha256, attempt); running: (kind, task_id, sha256).
    """
    fresh = requests.join(running, ["kind", "task_id", "sha256"], "left_anti").withColumn("job", job_key(F.col("kind"), F.col("task_id"), F.col("sha256"), F.col("attempt")))
    return fresh.groupBy("job").agg(F.min_by(F.struct("request_no", "kind", "task_id", "sha256", "attempt"), F.col("request_no")).alias("r")).select("job", "r.*")


def already_done(versions: DataFrame, sha256: Column, method: str) -> DataFrame:
    """Whether a task has records of this source and method: (task_id, done)."""
    return versions.groupBy("task_id").agg(F.bool_or(F.startswith("evidence_version", F.concat_ws(":", sha256, F.lit(method)))).alias("done"))


def claim_due(items: DataFrame, now: Column, *, batch: int = 100) -> DataFrame:
    """At most ``batch`` items that are due for cleaning, leased for a quarter of an hour; the longest due first."""
    due = items.where(F.col("status").isin(CLEANUP) & (F.col("cleanup_after") <= now)).orderBy("cleanup_after", "id").limit(batch)
    return due.withColumn("status", F.lit("purging")).withColumn("cleanup_after", now + F.expr(LEASE))


def finish_cleanup(claimed: DataFrame, now: Column) -> DataFrame:
    """What a claimed item becomes: purged, or to be tried again a lease later.  ``removed``: whether the object is gone."""
    ok = F.coalesce(F.col("removed"), F.lit(False))
    return (
        claimed.withColumn("status", F.when(ok, "purged").otherwise("purge_failed")).withColumn("cleanup_after", F.when(~ok, now + F.expr(LEASE)))
        .withColumn("cleanup_attempts", F.coalesce("cleanup_attempts", F.lit(0)) + F.when(ok, 0).otherwise(1)).drop("removed")
    )


def release_quota(users: DataFrame, released: DataFrame) -> DataFrame:
    """Users' counters less what purged items held: of the same day only, each item once, never below zero.

    users: (user_id, quota_date, quota_count, quota_bytes); released: (id,
    user_id, created_at, size_bytes, quota_released).
    """
    own = released.where("not coalesce(quota_released, false) and user_id is not null").groupBy("id").agg(F.first("user_id").alias("user_id"), F.first(F.to_date("created_at")).alias("_day"), F.first("size_bytes").alias("_b"))
    held = own.groupBy("user_id", "_day").agg(F.count("*").alias("_n"), F.sum("_b").alias("_s")).withColumnRenamed("user_id", "_u")
    j = users.join(held, (users["user_id"] == held["_u"]) & (users["quota_date"] == held["_day"]), "left")
    zero = F.lit(0)
    return j.select("user_id", "quota_date", F.greatest(zero, F.col("quota_count") - F.coalesce("_n", zero)).alias("quota_count"), F.greatest(zero, F.col("quota_bytes") - F.coalesce("_s", zero)).alias("quota_bytes"))


def valid_sessions(sessions: DataFrame, users: DataFrame, token: Column, now: Column) -> DataFrame:
    """Sessions of a token that haven't expired, of active users: (user_id, expires_at)."""
    live = sessions.where((F.col("token_hash") == F.sha2(token, 256)) & (F.col("expires_at") > now))
    return live.join(users.where("active").select("user_id"), "user_id", "left_semi").select("user_id", "expires_at")


def session_end(started: Column, *, public: bool) -> Column:
    """A public session lasts thirty days, a reviewer's twelve hours."""
    return started + F.expr("interval 30 days" if public else "interval 12 hours")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The current decision on each record: the last by time, then id."""
    return decisions.groupBy("evidence_id").agg(F.max_by(F.struct("decision_id", "evidence_code", "decision", "reason", "created_at"), F.struct("created_at", "decision_id")).alias("d")).select("evidence_id", "d.*")


def status_after(decision: Column) -> Column:
    """The state of a record after a decision."""
    return F.when(decision == "confirmed", "verified_anomaly").when(decision.isin("insufficient", "reasonable"), decision).otherwise("needs_review")


def completeness(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """(task_id, total, decided, complete): a task without records is complete."""
    d = latest_decisions(decisions).select("evidence_id", "decision")
    j = evidence.join(d, "evidence_id", "left")
    return j.groupBy("task_id").agg(F.count("*").alias("total"), F.count("decision").alias("decided"), (F.count("decision") == F.count("*")).alias("complete"))


def report_version(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """(task_id, version): SHA-256 of the JSON of (record, version, latest decision) in the order of the records' creation."""
    d = latest_decisions(decisions).select("evidence_id", "decision_id")
    rows = evidence.join(d, "evidence_id", "left").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "evidence_id", "evidence_version", "decision_id"))).alias("_r"))  # the records of one task
    lines = F.transform("_r", lambda r: F.concat(F.lit('["'), r["evidence_id"].cast("string"), F.lit('","'), r["evidence_version"], F.lit('",'), F.coalesce(F.concat(F.lit('"'), r["decision_id"].cast("string"), F.lit('"')), F.lit("null")), F.lit("]")))
    return rows.select("task_id", F.sha2(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")), 256).alias("version"))


def rollup(decisions: DataFrame) -> DataFrame:
    """(task_id, summary): how often each decision was taken, in the order of a report; those never taken left out."""
    n = decisions.where(F.col("decision").isin(DECISIONS)).groupBy("task_id", "decision").agg(F.count("*").alias("n"))
    place = F.create_map(*[x for i, k in enumerate(DECISIONS) for x in (F.lit(k), F.lit(i))])
    parts = F.array_sort(F.collect_list(F.struct(F.try_element_at(place, F.col("decision")).alias("p"), F.concat_ws(": ", "decision", F.col("n").cast("string")).alias("t"))))
    return n.groupBy("task_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "; ").alias("summary"))


def escape(text: Column) -> Column:
    """The characters that markup reserves, written as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    """Entities of markup, named and numbered, as characters."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def metadata_title(title: Column) -> Column:
    """The title that a file states about itself: entities read, white space compacted, empty as null."""
    from docsieve.functions.text import compact

    return F.nullif(compact(unescape(F.coalesce(title, F.lit("")))), F.lit(""))


def storage_key(task: Column, role: str, asset: Column, suffix: str) -> Column:
    """Where an object of a task is kept."""
    return F.concat_ws("/", F.lit("tasks"), task, F.lit(role), F.concat(asset, F.lit(suffix)))


def report_lines(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """(task_id, line, text): a report's records in order with place, confidence and decision.

    A decision counts by the record's id, else by its code (the last one taken).
    """
    from pyspark.sql import Window as W

    by_id = latest_decisions(decisions.where("evidence_id is not null")).select("evidence_id", F.col("decision").alias("_di"), F.col("reason").alias("_ri"))
    by_code = decisions.groupBy("task_id", F.col("evidence_code").alias("code")).agg(F.max_by(F.struct("decision", "reason"), F.struct("created_at", "decision_id")).alias("_c"))
    j = evidence.join(by_id, "evidence_id", "left").join(by_code, ["task_id", "code"], "left")
    line = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("severity"), "created_at", "evidence_id"))
    decision, reason = F.coalesce("_di", "_c.decision"), F.coalesce("_ri", "_c.reason")
    text = F.concat(F.col("code"), F.lit(", page "), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.lit(", confidence "), F.format_number("confidence", 2), F.coalesce(F.concat(F.lit(", decided "), decision, F.lit(": "), escape(reason)), F.lit("")))
    return j.withColumn("line", line).select("task_id", "line", "code", decision.alias("decision"), text.alias("text"))


def write_report(lines: DataFrame, coverage: DataFrame, path: str) -> None:
    """Report sink: one Markdown text for each task, coverage first, then the records."""
    body = lines.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.concat(x["line"].cast("string"), F.lit(". "), x["text"])), "\n").alias("_b"))  # one task's records
    head = coverage.select("task_id", F.to_json(F.struct(*[c for c in coverage.columns if c != "task_id"])).alias("_h"))
    joined = head.join(body, "task_id", "left").select("task_id", F.concat(F.lit("# Review\n\n```json\n"), F.col("_h"), F.lit("\n```\n\n"), F.coalesce("_b", F.lit("No records.")), F.lit("\n")).alias("report"))
    joined.write.mode("overwrite").parquet(path)
