"""The evidence record: one shape for every detector, its order, identity and sink.

Every finding starts as ``needs_review``; only a human decision changes that.
``build`` gives a detector's rows the common columns, ``union`` puts several
detectors together in a fixed order, ``identify`` adds fingerprint and version,
``collapse`` and ``merge`` make a repeated run idempotent.

Defined results: absent locations, excerpts and numbers are null; two findings
that differ only in their source excerpt or explanation have one fingerprint,
of which the first by ``seq`` and location is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.sources.settle import settle

LOCATION = "struct<document_id:string,page:int,bbox:array<double>,char_start:int,char_end:int,word_start:int,word_end:int>"
SOURCE = "struct<reference_id:string,ordinal:int,title:string,doi:string,sha256:string>"
METHOD = f"struct<detector:string,version:string,parameters:map<string,string>,score:double,subject_numbers:array<string>,source_numbers:array<string>,source:{SOURCE}>"
VERSION = "document-rules/1.0"
STATUS = "needs_review"
COLUMNS = [
    ("seq", "int"), ("code", "string"), ("category", "string"), ("status", "string"), ("severity", "string"), ("confidence", "double"), ("subject_location", LOCATION), ("source_location", LOCATION),
    ("subject_excerpt", "string"), ("source_excerpt", "string"), ("explanation", "string"), ("method", METHOD), ("limitations", "array<string>"), ("artifacts", "array<string>"),
]


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def location(document: Column, page: Column, bbox: Column | None = None, word_start: Column | None = None, word_end: Column | None = None) -> Column:
    """Where a finding stands; rule detectors leave the positions null."""
    return F.struct(
        document.cast("string").alias("document_id"), page.cast("int").alias("page"), (_null("array<double>") if bbox is None else bbox.cast("array<double>")).alias("bbox"), _null("int").alias("char_start"), _null("int").alias("char_end"),
        (_null("int") if word_start is None else word_start.cast("int")).alias("word_start"), (_null("int") if word_end is None else word_end.cast("int")).alias("word_end"),
    )


def source_identity(reference_id: Column | None = None, ordinal: Column | None = None, title: Column | None = None, doi: Column | None = None, sha256: Column | None = None) -> Column:
    parts = [("reference_id", reference_id, "string"), ("ordinal", ordinal, "int"), ("title", title, "string"), ("doi", doi, "string"), ("sha256", sha256, "string")]
    return F.struct(*[(_null(k) if c is None else c.cast(k)).alias(n) for n, c, k in parts])


def method(detector: str, *, version: str = VERSION, parameters: dict[str, Column] | None = None, score: Column | None = None, subject_numbers: Column | None = None, source_numbers: Column | None = None, source: Column | None = None) -> Column:
    given = F.create_map(*[x for k, v in (parameters or {}).items() for x in (F.lit(k), v.cast("string"))]).cast("map<string,string>")
    return F.struct(
        F.lit(detector).alias("detector"), F.lit(version).alias("version"), given.alias("parameters"), (_null("double") if score is None else score).alias("score"),
        (_null("array<string>") if subject_numbers is None else subject_numbers).alias("subject_numbers"), (_null("array<string>") if source_numbers is None else source_numbers).alias("source_numbers"), (_null(SOURCE) if source is None else source).alias("source"),
    )


def build(df: DataFrame, *, seq: int, code: str, category: str, severity: Column | str, confidence: Column | float, subject: Column, subject_excerpt: Column, explanation: Column | str, method: Column, source: Column | None = None, source_excerpt: Column | None = None, limitations: list[str] = (), artifacts: Column | None = None) -> DataFrame:
    """The evidence rows of one detector, with the subject's document beside them: the optimizer sees by it that rows already lie by document."""

    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    values = {
        "seq": F.lit(seq), "code": F.lit(code), "category": F.lit(category), "status": F.lit(STATUS), "severity": lit(severity), "confidence": lit(confidence).cast("double"), "subject_location": subject, "source_location": _null(LOCATION) if source is None else source,
        "subject_excerpt": subject_excerpt, "source_excerpt": _null("string") if source_excerpt is None else source_excerpt, "explanation": lit(explanation), "method": method,
        "limitations": F.array(*[F.lit(x) for x in limitations]).cast("array<string>"), "artifacts": F.array().cast("array<string>") if artifacts is None else artifacts,
    }
    return df.select(subject["document_id"].alias("document_id"), *[values[n].cast(k).alias(n) for n, k in COLUMNS])


def union(parts: list[DataFrame]) -> DataFrame:
    """All detectors' rows; ``seq`` keeps the order of the detectors."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_order() -> list[Column]:
    """The order of a listing: page and word of the subject, then document and word of the source; null counts as nothing."""
    s, r = F.col("subject_location"), F.col("source_location")
    return [F.coalesce(s["page"], F.lit(0)), F.coalesce(s["word_start"], F.lit(0)), F.coalesce(r["document_id"], F.lit("")), F.coalesce(r["word_start"], F.lit(0)), F.col("seq"), F.col("fingerprint")]


def fingerprint() -> Column:
    """SHA-256 of the canonical JSON of code, both locations and the subject's excerpt: keys sorted, nulls kept."""

    def sorted_location(c: str) -> Column:
        x = F.col(c)
        return F.when(x.isNotNull(), F.struct(*[x[k].alias(k) for k in sorted(("document_id", "page", "bbox", "char_start", "char_end", "word_start", "word_end"))]))

    record = F.struct("code", sorted_location("source_location").alias("source_location"), "subject_excerpt", sorted_location("subject_location").alias("subject_location"))
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def evidence_version(sha256: Column, digest: Column, version: str = VERSION) -> Column:
    """What a record is valid for: the source file, the method and the first 16 places of the index digest."""
    return F.concat_ws(":", sha256, F.lit(version), F.left(digest, F.lit(16)))


def identify(evidence: DataFrame, sha256: Column, digest: Column) -> DataFrame:
    return evidence.withColumn("fingerprint", fingerprint()).withColumn("evidence_version", evidence_version(sha256, digest))


KEY = ["document_id", "fingerprint", "evidence_version"]


def collapse(evidence: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each key, the first; ``collapsed`` counts the others.  An aggregation, combined map-side.

    ``columns``: those wanted beside the key, where others needn't be carried.
    Rows that come partitioned by document aren't moved again.
    """
    e = evidence if "document_id" in evidence.columns else evidence.withColumn("document_id", F.col("subject_location.document_id"))
    rest = [c for c in e.columns if c not in KEY and (columns is None or c in columns)]
    order = F.struct("seq", F.coalesce("source_location.document_id", F.lit("")), F.coalesce("source_excerpt", F.lit("")), F.coalesce("explanation", F.lit("")))
    return e.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("_v"), (F.count("*") - 1).alias("collapsed")).select(*KEY, *[F.col(f"_v.{c}").alias(c) for c in rest], "collapsed")


BROADCAST_KEYS = 50_000  # under 200 bytes each


def merge(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """``existing`` with the records of ``batch`` put in or over it by key; other versions stay.

    The batch is worked out once; a small one's keys go to the existing
    records, which then aren't moved.
    """
    new = settle(collapse(batch).drop("collapsed"), "evidence-batch")
    keys = new.select(*KEY)
    old = existing.join(F.broadcast(keys) if new.count() <= BROADCAST_KEYS else keys, KEY, "left_anti")
    return old.unionByName(new.select(*old.columns))


def write(existing_path: str, batch: DataFrame) -> None:
    """Evidence sink: the merged table replaces ``existing_path`` by a rename, so a lost executor leaves the old one in place."""
    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(existing_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = f"{existing_path}.next"
    first = collapse(batch).drop("collapsed")
    (merge(spark.read.parquet(existing_path), batch) if fs.exists(path) else first).write.mode("overwrite").parquet(new)
    fs.delete(path, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), path)


def audit(spark, path: str, rows: DataFrame) -> None:
    """Audit sink: append only; (task_id, event_type, details JSON, created_at)."""
    rows.select("task_id", "event_type", F.to_json("details").alias("details"), F.coalesce("created_at", F.current_timestamp()).alias("created_at")).write.mode("append").parquet(path)
