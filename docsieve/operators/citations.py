"""Whether cited works support what a text says of them.

Every citation context is held against all blocks of the works it cites: the
best block of each by the cosine of stem counts, then direction words, then
numbers.  Outcomes, in this order of decision:

``no_source``        none of the cited works has text
``missing_source``   some have none
``budget``           the document's comparisons are used up
``unaligned``        no best block is similar enough or shares a number
``direction``        an aligned block says the opposite
``ambiguous``        a direction can't be told
``numeric``          a number of the context stands in no aligned block
``match``            otherwise

Contexts within bibliography entries don't count.  Comparisons are numbered in
the order of the text, so the budget is a running sum and no order of execution
changes the result.  Without a budget every context is held against its works.

What a context comes to depends on its words, its ordinals and its document
only, so equal contexts of a document are held against the works once.

Defined results: null texts have no contexts; an ordinal that two works carry
means the later one; a cited work without blocks has no text; an empty corpus
leaves every context ``no_source``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.operators import evidence as E
from docsieve.operators.detectors import by_text, found_citations
from docsieve.sources.settle import settle

VERSION = "citation-support/1.0"
MIN_SCORE = 0.42
BUDGET = 50_000
_ENTRY = r"^\s*\[\d+(?:\s*[-–,;]\s*\d+)*\]"  # a block that begins so is an entry of the bibliography


def without_entries(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Blocks that aren't entries of a bibliography."""
    return blocks.where(~F.coalesce(F.col(text).rlike(_ENTRY), F.lit(False)))


def contexts_of(blocks: DataFrame, document: str, order: str, works: DataFrame | None = None) -> DataFrame:
    """(document, order, page, bbox, text, context, ordinals, ctx): the distinct contexts of each block in its order, the first of equal ones kept.

    With ``works`` (document, _works: blocks by ordinal) also what each has to
    be compared with: (_known, _need) and, in _run, that of all up to it which
    can be scored.  One sort of each document.
    """

    def number(found: DataFrame) -> DataFrame:
        place = W.partitionBy(document).orderBy(order, "at", "context")
        numbers = F.row_number().over(place)
        if works is None:
            return found.withColumn("ctx", numbers)
        sizes = F.filter(F.transform("ordinals", lambda o: F.try_element_at("_works", o)), lambda n: n.isNotNull())
        n = found.join(works, document, "left").withColumn("_sizes", sizes).withColumn("_known", F.coalesce(F.size("_sizes"), F.lit(0)))
        n = n.withColumn("_need", F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda a, v: a + v)).withColumn("_scores", (F.col("_known") == F.size("ordinals")) & (F.col("_known") > 0))
        so_far = F.sum(F.when(F.col("_scores"), F.col("_need")).otherwise(0)).over(place.rowsBetween(W.unboundedPreceding, 0))
        return n.withColumn("ctx", numbers).withColumn("_run", so_far).drop("_works", "_sizes")

    own = blocks.select(document, order, "page", "bbox", "text")
    return by_text(own, lambda df: found_citations(without_entries(df)), ["context", "ordinals", "at"], number).drop("at", "_k")


def bags(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys.., stem, tf, sq): stem counts with the squared norm of each text."""
    stems = df.select(*keys, T.stems(T.words(text)).alias("_s"))
    # counted inside the row: no shuffle
    tf = F.transform(F.array_distinct("_s"), lambda w: F.struct(w.alias("stem"), F.size(F.filter("_s", lambda x: x == w)).alias("tf")))
    counted = stems.select(*keys, tf.alias("_t")).withColumn("sq", F.aggregate("_t", F.lit(0), lambda a, x: a + x["tf"] * x["tf"]))
    return counted.select(*keys, "sq", F.explode("_t").alias("t")).select(*keys, "sq", "t.stem", "t.tf")


def support(blocks: DataFrame, works: DataFrame, source_blocks: DataFrame, *, document: str = "document_id", order: str = "block_idx", min_score: float = MIN_SCORE, budget: int | None = BUDGET) -> DataFrame:
    """One row for each citation context with its outcome.

    blocks: (document, order, page, bbox, text); works: (document, ordinal,
    doc_idx, source_id, title, doi, sha256, reference_id); source_blocks:
    (source_id, source_idx, source_page, source_bbox, source_text); a budget of
    None compares all.

    Rows: (document, order, page, bbox, text, context, ordinals, ctx,
    comparisons, outcome, score, missing, subject_numbers, source_numbers,
    best), where ``best`` is the aligned block that a finding names.
    """
    key, same = ["_class"], [document, "context", "ordinals"]
    sizes = source_blocks.groupBy("source_id").agg(F.count("*").alias("n_blocks"))
    known = works.where("ordinal > 0").groupBy(document, "ordinal").agg(F.max_by(F.struct("source_id", "title", "doi", "sha256", "reference_id"), F.col("doc_idx")).alias("w"))
    known = settle(known.select(document, F.col("ordinal").cast("int").alias("ordinal"), "w.*").join(sizes, "source_id"), "cited-works")  # works without text are as good as absent
    listed = known.groupBy(document).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "n_blocks"))).alias("_works"))  # one document's bibliography
    state = contexts_of(blocks, document, order, listed).withColumn("_cut", F.lit(False) if budget is None else F.col("_scores") & (F.col("_run") > budget))
    allowed = F.col("_need") if budget is None else F.greatest(F.lit(0), F.least(F.col("_need"), F.col("_need") - F.col("_run") + budget))
    state = settle(state.withColumn("comparisons", F.when(F.col("_scores"), allowed).otherwise(0).cast("bigint")), "citation-contexts")
    compared = state.where("_scores and not _cut")
    ctx = settle(compared.select(*same).distinct().withColumn("_class", F.monotonically_increasing_id()), "live-contexts")  # read at several places
    live = ctx.select(*key, document, F.explode("ordinals").alias("ordinal")).join(known, [document, "ordinal"]).select(*key, "ordinal", "source_id", "title", "doi", "sha256", "reference_id")

    mine = bags(ctx, key, F.regexp_replace("context", r"\[[^\]]+\]", "")).select(*key, F.col("sq").alias("_ls"), "stem", F.col("tf").alias("_lt"))
    theirs = bags(source_blocks.join(live.select("source_id").distinct(), "source_id", "left_semi"), ["source_id", "source_idx"], F.col("source_text")).select("source_id", "source_idx", F.col("sq").alias("_rs"), "stem", F.col("tf").alias("_rt"))
    dots = live.select(*key, "source_id").join(mine, key).join(theirs, ["source_id", "stem"]).groupBy(*key, "source_id", "source_idx").agg(F.sum(F.col("_lt") * F.col("_rt")).alias("_dot"), F.first("_ls").alias("_ls"), F.first("_rs").alias("_rs"))
    scored = dots.select(*key, "source_id", "source_idx", (F.col("_dot") / (F.sqrt(F.col("_ls").cast("double")) * F.sqrt(F.col("_rs").cast("double")))).alias("score"))
    top = scored.groupBy(*key, "source_id").agg(F.max_by(F.struct("source_idx", "score"), F.struct("score", (-F.col("source_idx")).alias("n"))).alias("_b"))
    first = source_blocks.groupBy("source_id").agg(F.min("source_idx").alias("_first"))  # nothing in common with any block: the first one
    best = live.join(top, [*key, "source_id"], "left").join(first, "source_id").select(*key, "ordinal", "source_id", "title", "doi", "sha256", "reference_id", F.coalesce("_b.source_idx", "_first").alias("source_idx"), F.coalesce("_b.score", F.lit(0.0)).alias("score"))
    best = best.join(source_blocks, ["source_id", "source_idx"]).join(ctx.select(*key, "context"), key)
    numbers, there = T.number_strings(F.col("context")), T.number_strings(F.col("source_text"))
    best = best.withColumn("subject_numbers", numbers).withColumn("_there", there).where((F.col("score") >= min_score) | F.arrays_overlap("subject_numbers", "_there"))
    best = best.withColumn("_ct", T.words(F.col("context"))).withColumn("_st", T.words(F.col("source_text")))  # split once, read at many places
    best = best.withColumn("_cw", T.direction_event(F.col("_ct"))).withColumn("_sw", T.direction_event(F.col("_st")))
    item = F.struct("ordinal", "score", "source_id", "source_idx", "source_page", "source_bbox", "source_text", "title", "doi", "sha256", "reference_id")
    relation = T.direction_relation(F.col("_cw"), F.col("_sw"))
    aligned = best.withColumn("_rel", relation).groupBy(*key).agg(
        F.max_by(item, F.struct("score", (-F.col("ordinal")).alias("n"))).alias("_top"), F.min_by(F.when(F.col("_rel") == "conflict", item), F.when(F.col("_rel") == "conflict", F.col("ordinal"))).alias("_against"),
        F.bool_or(F.col("_rel") == "ambiguous").alias("_unclear"), F.first("subject_numbers").alias("subject_numbers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_there")))).alias("source_numbers"),
    )
    rest = state.where("not _scores or _cut").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in aligned.schema if f.name not in key])  # nothing to join
    found = settle(ctx.join(aligned, key, "left").drop(*key), "aligned-contexts")
    out = compared.join(found, same).unionByName(rest).withColumn("missing", F.array_except("subject_numbers", "source_numbers"))
    outcome = (
        F.when(F.col("_known") == 0, "no_source").when(~F.col("_scores"), "missing_source").when(F.col("_cut"), "budget").when(F.col("_top").isNull(), "unaligned")
        .when(F.col("_against").isNotNull(), "direction").when(F.col("_unclear"), "ambiguous").when(F.size("missing") > 0, "numeric").otherwise("match")
    )
    named = F.coalesce("_against", "_top")
    return out.select(document, order, "page", "bbox", "text", "context", "ordinals", "ctx", "comparisons", outcome.alias("outcome"), named["score"].alias("score"), "missing", "subject_numbers", "source_numbers", named.alias("best"))


def coverage(supported: DataFrame, document: str = "document_id", budget: int = BUDGET) -> DataFrame:
    """The nine counters of each document, zeros filled in."""
    o = F.col("outcome")
    return supported.groupBy(document).agg(
        F.count("*").alias("citation_contexts_detected"), F.count_if(o != "no_source").alias("citation_contexts_with_full_text"), F.count_if(o == "match").alias("citation_support_matches"),
        F.count_if(o.isin("no_source", "missing_source", "budget", "unaligned", "ambiguous")).alias("citation_support_unresolved"), F.count_if(o == "numeric").alias("citation_numeric_mismatches"), F.count_if(o == "direction").alias("citation_direction_conflicts"),
        F.sum("comparisons").alias("citation_candidate_comparisons"), F.lit(budget).cast("bigint").alias("citation_candidate_budget"), F.max((o == "budget").cast("int")).alias("citation_candidate_budget_exhausted"),
    )


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.96), 0.55 + 0.4 * score), 3)


def findings(supported: DataFrame, document: str = "document_id") -> DataFrame:
    """Evidence rows of contexts whose cited works say the opposite or lack their numbers."""
    b = F.col("best")
    common = {
        "category": "citation_support", "confidence": confidence(F.col("score")), "subject": E.location(F.col(document), F.col("page"), F.col("bbox")), "source": E.location(b["source_id"], b["source_page"], b["source_bbox"]),
        "subject_excerpt": F.col("context"), "source_excerpt": b["source_text"], "artifacts": F.array(b["source_id"].cast("string")),
    }
    who = E.source_identity(b["reference_id"], b["ordinal"], b["title"], b["doi"], b["sha256"])
    score = F.round("score", 3)
    against = E.build(
        supported.where("outcome = 'direction'"), seq=20, code="citation_direction_conflict_candidate", severity="high", explanation=F.concat(F.lit("The text and the closest passage of source "), b["ordinal"].cast("string"), F.lit(" point in opposite directions.")),
        method=E.method("citation-direction", version=VERSION, score=score, source=who), limitations=["Negation, subgroups, time points and wider context may explain the difference."], **common,
    )
    numeric = E.build(
        supported.where("outcome = 'numeric'"), seq=21, code="citation_numeric_mismatch_candidate", severity="medium", explanation=F.concat(F.lit("The closest passages of the cited sources don't hold "), F.array_join("missing", ", "), F.lit(".")),
        method=E.method("citation-numbers", version=VERSION, score=score, subject_numbers=F.col("subject_numbers"), source_numbers=F.col("source_numbers"), source=who), limitations=["Numbers may stand in tables, figures or parts that weren't extracted."], **common,
    )
    return against.unionByName(numeric)
