"""Bibliographic lookup, guarded downloads and the reference corpus, over captured responses.

The network stays outside: answers of the two services and attempts to fetch
come in as tables, and what follows from them is decided here.

Defined results: a reference without an answer is ``lookup_failed``; null
fields neither support nor contradict a candidate; a URL that can't be read
isn't public; items of unknown size count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import doi, words

MIN_SCORE = 30.0
MAX_REDIRECTS = 5
MAX_BYTES, MAX_PAGES = 52_428_800, 500
CORPUS = {"items": 100, "bytes": 524_288_000, "pages": 5_000, "characters": 20_000_000}
INDEX_BYTES = 104_857_600

CANDIDATE = "struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,published:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,score:double>"
ANSWER = f"struct<message:struct<items:array<{CANDIDATE}>,{CANDIDATE[7:]}>"
OPEN_ACCESS = "struct<open_access:struct<is_oa:boolean>,best_oa_location:struct<pdf_url:string>,locations:array<struct<is_oa:boolean,pdf_url:string>>>"


def first_of(values: Column) -> Column:
    """The first of a list; null for none or an empty one."""
    return F.nullif(F.try_element_at(values, F.lit(1)), F.lit(""))


def family(name: Column) -> Column:
    """The last word of a name, lower-cased."""
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def candidate_year(c: Column) -> Column:
    part = F.coalesce(c["published"], c["published-print"])["date-parts"]
    return F.try_element_at(F.try_element_at(part, F.lit(1)), F.lit(1)).cast("string")


def candidate_matches(reference: dict[str, Column], c: Column) -> Column:
    """Whether a candidate is the work of a reference (title, raw_citation, authors, year).

    At least three title words of three letters, four fifths of which stand in
    the reference's title, or in its raw citation where it has none; a stated
    title must be covered as far in turn.  Year and families must not differ,
    and without a stated title one of them must agree.
    """
    stated = F.nullif(F.trim(reference["title"]), F.lit(""))
    theirs = F.array_distinct(F.filter(words(F.coalesce(first_of(c["title"]), F.lit(""))), lambda w: F.length(w) >= 3))
    mine = F.array_distinct(words(F.coalesce(stated, reference["raw_citation"], F.lit(""))))
    common = F.size(F.array_intersect(theirs, mine)).cast("double")
    titled = (F.size(theirs) >= 3) & (common / F.greatest(F.size(theirs), F.lit(1)) >= 0.8) & (stated.isNull() | (common / F.greatest(F.size(mine), F.lit(1)) >= 0.8))
    y, cy = F.nullif(reference["year"], F.lit("")), candidate_year(c)
    same_year, other_year = F.coalesce(y == cy, F.lit(False)), F.coalesce(y != cy, F.lit(False))
    families = F.transform(F.filter(F.coalesce(reference["authors"], F.array().cast("array<string>")), lambda a: F.trim(a) != ""), family)
    named = F.transform(F.filter(F.coalesce(c["author"], F.expr("cast(array() as array<struct<given:string,family:string>>)")), lambda a: F.coalesce(a["family"], F.lit("")) != ""), lambda a: F.lower(a["family"]))
    both = (F.size(families) > 0) & (F.size(named) > 0)
    shared = both & F.coalesce(F.arrays_overlap(families, named), F.lit(False))
    return F.coalesce(titled & ~other_year & (~both | shared) & (stated.isNotNull() | same_year | shared), F.lit(False))


def resolve(references: DataFrame, answers: DataFrame, open_access: DataFrame) -> DataFrame:
    """The status machine of a lookup: (reference_id, doi, title, authors, year, venue, metadata_status, full_text_status, access_url).

    references: (reference_id, doi, raw_citation, title, authors, year, venue);
    answers: (reference_id, status, body), body the JSON of the service, a
    single record for a DOI and a list for a search; open_access: (doi, status,
    body).  A search result counts from a score of 30 if it matches.
    """
    r = references.join(answers.select("reference_id", F.col("status").alias("_s"), F.from_json("body", ANSWER).alias("_a")), "reference_id", "left")
    asked = doi(F.col("doi"))
    ok = F.coalesce((F.col("_s") >= 200) & (F.col("_s") < 300) & F.col("_a.message").isNotNull(), F.lit(False))
    found = F.try_element_at(F.col("_a.message.items"), F.lit(1))
    single = F.col("_a.message")
    one = F.struct(*[F.when(asked.isNotNull(), single[k]).otherwise(found[k]).alias(k) for k in ("DOI", "title", "author", "published", "published-print", "container-title", "score")])
    r = r.withColumn("_asked", asked).withColumn("_ok", ok).withColumn("_c", one)
    parts = {k: F.col(k) for k in ("title", "raw_citation", "authors", "year")}
    unsure = F.col("_asked").isNull() & ~(F.coalesce(F.col("_c.score") >= MIN_SCORE, F.lit(False)) & candidate_matches(parts, F.col("_c")))
    r = r.withColumn("metadata_status", F.when(~F.col("_ok"), "lookup_failed").when(unsure, "ambiguous").otherwise("resolved")).withColumn("_good", F.col("metadata_status") == "resolved")
    full = F.filter(F.transform(F.col("_c.author"), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != "")
    better = {
        "doi": F.coalesce(doi(F.col("_c.DOI")), F.col("_asked")), "title": F.coalesce(first_of(F.col("_c.title")), F.col("title")), "authors": F.when(F.size(full) > 0, full).otherwise(F.col("authors")),
        "year": F.coalesce(candidate_year(F.col("_c")), F.col("year")), "venue": F.coalesce(first_of(F.col("_c.container-title")), F.col("venue")),
    }
    r = r.select("reference_id", "metadata_status", *[F.when(F.col("_good"), v).otherwise(F.col(k)).alias(k) for k, v in better.items()])
    w = open_access.select(doi(F.col("doi")).alias("_w"), F.col("status").alias("_ws"), F.from_json("body", OPEN_ACCESS).alias("_o"))
    j = r.join(w, r["doi"] == w["_w"], "left")
    url = F.when(F.col("_o.open_access.is_oa"), F.coalesce(F.nullif(F.col("_o.best_oa_location.pdf_url"), F.lit("")), F.try_element_at(F.filter("_o.locations", lambda x: x["is_oa"] & (F.coalesce(x["pdf_url"], F.lit("")) != "")), F.lit(1))["pdf_url"]))
    answered = F.coalesce((F.col("_ws") >= 200) & (F.col("_ws") < 300) & F.col("_o").isNotNull(), F.lit(False))
    status = F.when(F.col("metadata_status") != "resolved", "metadata_unavailable").when(F.col("doi").isNull(), "identifier_missing").when(~answered, "oa_lookup_failed").when(url.isNotNull(), "available").otherwise("not_open_access")
    return j.select("reference_id", "doi", "title", "authors", "year", "venue", "metadata_status", status.alias("full_text_status"), F.when(status == "available", url).alias("access_url"))


# --- which addresses may be fetched -----------------------------------------------------------------

# The address blocks of version 4 that aren't globally reachable, and those of version 6 by prefix.
RESERVED_4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
RESERVED_6 = ["::/8", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8"]


def _number(quad: Column) -> Column:
    parts = F.transform(F.split(quad, r"\."), lambda p: p.try_cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)


def _bits(words_: Column) -> Column:
    """The 128 bits of an address in eight hexadecimal groups, as text."""
    return F.array_join(F.transform(words_, lambda w: F.lpad(F.conv(F.when(w == "", "0").otherwise(w), 16, 2), 16, "0")), "")


def _groups(address: Column) -> Column:
    """The eight groups of a version 6 address; null if it isn't one."""
    has_gap = F.contains(address, F.lit("::"))
    head = F.split(F.regexp_replace(address, r"::.*$", ""), ":")
    tail = F.split(F.regexp_replace(address, r"^.*::", ""), ":")
    kept_head, kept_tail = F.filter(head, lambda w: w != ""), F.when(has_gap, F.filter(tail, lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(kept_head) - F.size(kept_tail)))
    full = F.when(has_gap, F.concat(kept_head, gap, kept_tail)).otherwise(head)
    valid = (F.size(full) == 8) & F.forall(full, lambda w: w.rlike("^[0-9a-f]{1,4}$")) & ~address.rlike("::.*::|:::") & (~has_gap | (F.size(kept_head) + F.size(kept_tail) < 8))
    return F.when(valid, full)


def public_address(address: Column) -> Column:
    """Whether a literal address is globally reachable; one of version 6 that holds one of version 4 counts as that."""
    a = F.lower(address)
    quad = F.regexp_extract(a, r"^(?:::ffff:)?(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    is4 = (quad != "") & F.forall(F.split(quad, r"\."), lambda p: p.try_cast("int") <= 255)
    n = _number(quad)
    blocked4 = F.lit(False)
    for block in RESERVED_4:
        base, size = block.split("/")
        low = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
        blocked4 = blocked4 | n.between(low, low + (1 << (32 - int(size))) - 1)
    bits = _bits(_groups(a))
    blocked6 = F.lit(False)
    for block in RESERVED_6:
        base, size = block.split("/")
        groups = [g or "0" for g in base.split("::")[0].split(":")]
        prefix = "".join(f"{int(g, 16):016b}" for g in groups).ljust(128, "0")[: int(size)]
        blocked6 = blocked6 | bits.startswith(prefix)
    return F.when(is4, ~blocked4).when(quad != "", F.lit(False)).otherwise(F.coalesce(~blocked6, F.lit(False)))


def public_url(url: Column) -> Column:
    """Whether a URL may be fetched: http or https, a host, no user information, no literal address that isn't global.

    A host is a dotted quad, a bracketed version 6 address or a name with a
    letter in its last label; other spellings of numbers are refused.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    six = F.regexp_extract(host, r"^\[([0-9a-f:.]+)\]$", 1)
    quad = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    name = host.rlike(r"^(?:[a-z0-9\x{80}-\x{10ffff}_](?:[a-z0-9\x{80}-\x{10ffff}_-]*)\.)+[a-z\x{80}-\x{10ffff}][a-z0-9\x{80}-\x{10ffff}-]*\.?$") & ~host.rlike(r"(?:^|\.)(?:localhost|local|internal|home\.arpa)\.?$") & ~host.rlike(r"(?:^|\.)0x[0-9a-f]*\.?$")
    fits = F.when(quad, public_address(host)).when(six != "", public_address(six)).otherwise(name)
    return F.coalesce(scheme.isin("http", "https") & (host != "") & ~F.contains(authority, F.lit("@")) & fits, F.lit(False))


def fetch_outcomes(attempts: DataFrame) -> DataFrame:
    """(fetch_id, outcome, hops): what became of each guarded download.

    attempts: (fetch_id, hop, url, status, location, addresses, declared_bytes,
    read_bytes, head, pages), one row for each request of a chain of redirects.
    The first hop that breaks a rule decides.
    """
    redirect = F.col("status").isin(301, 302, 303, 307, 308)
    safe = public_url(F.col("url")) & (F.size(F.coalesce("addresses", F.array().cast("array<string>"))) > 0) & F.coalesce(F.forall("addresses", public_address), F.lit(False))
    verdict = (
        F.when(~safe, "blocked_address").when(F.col("hop") > MAX_REDIRECTS, "too_many_redirects").when(redirect & F.coalesce(F.col("location") == "", F.lit(True)), "redirect_without_target").when(redirect, F.lit(None))
        .when(~F.coalesce(F.col("status") == 200, F.lit(False)), "http_error").when(F.greatest(F.coalesce("declared_bytes", F.lit(0)), F.coalesce("read_bytes", F.lit(0))) > MAX_BYTES, "too_large")
        .when(~F.coalesce(F.col("head").startswith("%PDF-"), F.lit(False)), "not_pdf").when(F.coalesce("pages", F.lit(0)) > MAX_PAGES, "too_many_pages").otherwise("obtained")
    )
    v = attempts.withColumn("_v", verdict)
    return v.groupBy("fetch_id").agg(F.min_by(F.when(F.col("_v").isNotNull(), F.col("_v")), F.when(F.col("_v").isNotNull(), F.col("hop"))).alias("_o"), F.count("*").alias("hops")).select("fetch_id", F.coalesce("_o", F.lit("incomplete")).alias("outcome"), "hops")


# --- the reference corpus ----------------------------------------------------------------------------

_FOLD = """aggregate(array_sort(_i), named_struct('n', cast(0 as bigint), 'b', cast(0 as bigint), 'p', cast(0 as bigint), 'c', cast(0 as bigint), 'rows', filter(transform(_i, x -> named_struct('o', x.o, 'taken', false, 'n', cast(0 as bigint), 'b', cast(0 as bigint), 'p', cast(0 as bigint), 'c', cast(0 as bigint))), x -> false)),
 (acc, x) -> if(acc.n >= {items} or acc.b + x.b > {bytes} or acc.p + x.p > {pages} or acc.c + x.c > {characters},
   named_struct('n', acc.n, 'b', acc.b, 'p', acc.p, 'c', acc.c, 'rows', concat(acc.rows, array(named_struct('o', x.o, 'taken', false, 'n', acc.n, 'b', acc.b, 'p', acc.p, 'c', acc.c)))),
   named_struct('n', acc.n + 1, 'b', acc.b + x.b, 'p', acc.p + x.p, 'c', acc.c + x.c, 'rows', concat(acc.rows, array(named_struct('o', x.o, 'taken', true, 'n', acc.n + 1, 'b', acc.b + x.b, 'p', acc.p + x.p, 'c', acc.c + x.c))))), acc -> acc.rows)"""


def corpus_budget(texts: DataFrame, task: str, order: str, **limits: int) -> DataFrame:
    """(task, order, taken, documents, bytes, pages, characters): running totals of the texts a task takes.

    texts: (task, order, bytes, pages, characters).  One that would exceed any
    limit is skipped and later ones may still fit.  The fold is over the sizes
    of one task's items, which its own limits bound.
    """
    bound = {**CORPUS, **limits}
    each = F.struct(F.col(order).alias("o"), *[F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k[0]) for k in ("bytes", "pages", "characters")])
    folded = texts.groupBy(task).agg(F.collect_list(each).alias("_i")).select(task, F.explode(F.expr(_FOLD.format(**bound))).alias("r"))
    return folded.select(task, F.col("r.o").alias(order), "r.taken", F.col("r.n").alias("documents"), F.col("r.b").alias("bytes"), F.col("r.p").alias("pages"), F.col("r.c").alias("characters"))


def reusable(references: DataFrame, assets: DataFrame) -> DataFrame:
    """``references`` with ``reuse``: whether their full text is held already and active."""
    active = assets.where("retention_state = 'active'").select(F.col("id").alias("full_text_asset_id"), F.lit(True).alias("_active"))
    return references.join(active, "full_text_asset_id", "left").withColumn("reuse", F.coalesce("_active", F.lit(False))).drop("_active")


def index_digest(documents: DataFrame, task: str, order: str, asset: str) -> DataFrame:
    """(task, digest): SHA-256 of the assets in their order, joined by a bar."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(asset).cast("string").alias("a")))), lambda x: x["a"])
    return documents.groupBy(task).agg(F.sha2(F.array_join(ids, "|"), 256).alias("digest"))


def within_index(documents: DataFrame, task: str, order: str, size: str, *, budget: int = INDEX_BYTES) -> DataFrame:
    """Documents whose postings fit the task's index: the last ones go until the rest does."""
    from pyspark.sql import Window as W

    total = F.sum(size).over(W.partitionBy(task).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return documents.withColumn("index_bytes", total).where(F.col("index_bytes") <= budget)


def write_index(postings: DataFrame, path: str, task: str) -> None:
    """Index sink: postings partitioned by task, so one task's index is replaced or purged alone."""
    postings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task).parquet(path)
