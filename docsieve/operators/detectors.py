"""Rule and arithmetic detectors over text blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.functions.text import citation_ordinals, general, matches_with_offsets, repair_decimals, sentence_around
from docsieve.sources.settle import settle

_NUM = r"\d+(?:\.\d+)?"
# Fixed values of the result contract: the patterns of claims.
MEASUREMENT = rf"{_NUM}\s*(?:±|\+\s*/\s*-)\s*{_NUM}"
UNITS_AVERAGE = "meV|eV|nm|ns|ms|ps|%"
UNITS_MEASURED = "ns|ms|ps|s|meV|eV|nm|μm|µm|mm|cm|Hz|kHz|MHz|GHz|%"
CONDITION = r"\d+(?:[.]\d+)?\s*(?:K|°C|°F)|room temperature|RT"
SUBJECTS = r"temperatures?|conditions?|groups?|cohorts?|samples?|specimens?|participants?|patients?|animals?|emitters?|quantum dots?|QDs?|measurements?|experiments?|timepoints?|visits?"
MISMATCH = (
    r"(?i)\bnot\s+(?:obtained|recorded|measured|collected|derived)\s+from\s+(?:the\s+)?same\s+(?:samples?|specimens?|subjects?|participants?|patients?|animals?|emitters?|quantum dots?|QDs?|cohorts?|groups?)\b"
    r"|\bdifferent\s+(?:samples?|specimens?|subjects?|participants?|patients?|animals?|emitters?|quantum dots?|QDs?|cohorts?|groups?)\b"
)
# Fixed values of the result contract: words that don't count as context.
CONTEXT_STOP = (
    "about after before condition conditions data from into measured measurement measurements obtained reported result results same than that their these this under value values were with"
).split()

REPEATED, CLASS_CHARACTERS = 8, 8_000_000  # how often a text stands on average, and how much all of them hold, for them to be read once


def by_text(blocks: DataFrame, find: Callable[[DataFrame], DataFrame], light: list[str], number: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows of ``find`` over blocks with a ``text``, numbered by ``number``; a text that many blocks have is read once.

    ``find`` gives one row for each finding of a text, ``_k`` being its place;
    ``number`` sees the block's columns, ``_k`` and the ``light`` ones, so
    neither texts nor what was found in them are moved.  The different texts
    are sent to all executors, so there must be few; otherwise every block is
    read by itself.  Both ways give the same rows.
    """
    many = blocks.agg(F.count("*").alias("n"), F.approx_count_distinct("text").alias("d"), F.avg(F.length("text")).alias("l")).first()  # decides on the way only
    if not many.d or many.d * REPEATED > many.n or many.d * many.l > CLASS_CHARACTERS:
        return number(find(blocks))
    found = settle(find(blocks.select("text").distinct().withColumn("_tid", F.monotonically_increasing_id())), "found-in-texts")
    rows = number(blocks.join(F.broadcast(found.select("text", "_tid", "_k", *light)), "text").drop("text"))
    return rows.join(F.broadcast(found.drop(*light)), ["_tid", "_k"]).drop("_tid")


def data_on_request(blocks: DataFrame) -> DataFrame:
    """Blocks that offer their data on reasonable request only."""
    low = F.lower("text")
    return blocks.where(F.contains(low, F.lit("available")) & F.contains(low, F.lit("reasonable request")))


def cross_condition(blocks: DataFrame) -> DataFrame:
    """Blocks that compare results of different subjects, with the wording found."""
    hit = F.regexp_extract("text", MISMATCH, 0)
    return blocks.where(F.col("text").rlike(MISMATCH) & F.col("text").rlike(rf"(?i)\b(?:{SUBJECTS})\b")).withColumn("marker", hit)


THRESHOLD_CLAIMS, AVERAGE_CLAIMS, LIST_COMPARISONS = 1_000, 500, 5_000  # examined in one document


def threshold_claims(blocks: DataFrame, document: str, order: list[str], *, budget: int = THRESHOLD_CLAIMS) -> DataFrame:
    """(block columns.., claim, examined, value, uncertainty, threshold, upper, consistent, calculation, marker): every '( < t )' of each document.

    ``claim`` numbers a document's claims in order; those beyond the budget
    aren't examined.  A claim is held against the last 'v ± u' in the 120
    characters before it; without one the numbers are null.
    """
    keep = blocks.columns

    def find(df: DataFrame) -> DataFrame:
        fixed = df.withColumn("_t", repair_decimals(F.col("text")))
        marks = fixed.select(*df.columns, "_t", F.posexplode(matches_with_offsets(F.col("_t"), rf"\(\s*<\s*{_NUM}\s*\)")).alias("_k", "_m"))
        start = F.greatest(F.lit(0), F.col("_m.at") - 120)
        before = F.substr(F.col("_t"), start + 1, F.col("_m.at") - start)
        rows = marks.withColumn("_l", F.try_element_at(matches_with_offsets(before, MEASUREMENT), F.lit(-1)))
        marker = F.substr(F.col("_t"), start + F.col("_l.at") + 1, F.col("_m.at") + F.length("_m.m") - start - F.col("_l.at"))
        value = F.regexp_extract("_l.m", rf"^({_NUM})", 1).try_cast("double")
        uncertainty = F.regexp_extract("_l.m", rf"({_NUM})$", 1).try_cast("double")
        threshold = F.regexp_extract("_m.m", rf"({_NUM})", 1).try_cast("double")
        rows = rows.select(*df.columns, "_k", value.alias("value"), uncertainty.alias("uncertainty"), threshold.alias("threshold"), marker.alias("marker"))
        upper = F.col("value") + F.col("uncertainty")
        return with_calculation(rows.withColumn("upper", upper).withColumn("consistent", upper < F.col("threshold")))

    rows = by_text(blocks, find, [], lambda df: df.withColumn("claim", F.row_number().over(W.partitionBy(document).orderBy(*order, "_k"))).withColumn("examined", F.col("claim") <= budget))
    seen = [F.when(F.col("examined"), F.col(c)).alias(c) for c in ("value", "uncertainty", "threshold", "upper", "consistent", "calculation")]
    seen[2] = F.col("threshold")
    return rows.select(*keep, "claim", "examined", *seen, "marker")


def threshold_checks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., value, uncertainty, threshold, upper, consistent): every claim that has a measurement."""
    c = threshold_claims(blocks.select(*keys, "text"), keys[0], keys[1:] or keys[:1], budget=2**31 - 1)
    return c.where("value is not null").select(*keys, "value", "uncertainty", "threshold", "upper", "consistent")


def with_calculation(checks: DataFrame) -> DataFrame:
    """Threshold checks with their disclosed calculation."""
    sign = F.when(F.col("consistent"), "<").otherwise("≥")
    return checks.withColumn("calculation", F.concat_ws(" ", general(F.col("value")), F.lit("+"), general(F.col("uncertainty")), F.lit("="), general(F.col("upper")), sign, general(F.col("threshold"))))


def average_claims(blocks: DataFrame, document: str, order: list[str], *, budget: int = AVERAGE_CLAIMS, lists: int = LIST_COMPARISONS) -> DataFrame:
    """(block columns.., claim, examined, compared, unit, numbers, computed, reported, consistent, calculation, marker): every reported average.

    A backward as-of join inside each block: among the lists of the claim's
    unit that end at or before it the nearest, the earlier on ties.  A document's
    claims are examined in order up to ``budget``, and each looks at its block's
    lists as long as the document's list comparisons stay within ``lists``: the
    claim that uses them up sees the lists that are left, later claims of its
    block see none, and later blocks aren't examined.
    """
    keep = blocks.columns
    claim = rf"(?i)average\s+[A-Za-z()\- ]{{0,32}}?\s*(?:of|=)\s*(?:approximately|≈|~)?\s*{_NUM}\s*(?:{UNITS_AVERAGE})(?![A-Za-z])"
    listed = rf"(?i){_NUM}(?:\s*,\s*{_NUM}){{2,}}\s*,?\s*(?:and\s*)?{_NUM}\s*(?:{UNITS_AVERAGE})(?![A-Za-z])"
    unit = rf"(?i)({UNITS_AVERAGE})$"
    stop = lambda l: l["at"] + F.length(l["m"])
    mine = F.lower(F.regexp_extract("_c.m", unit, 1))

    def values(l: Column) -> Column:
        return F.regexp_extract_all(l["m"], F.lit(rf"({_NUM})"), F.lit(1))

    def against(df: DataFrame, seen: Column) -> DataFrame:
        """What the claim ``_c`` comes to against the lists ``seen``."""
        fitting = F.filter(seen, lambda l: (F.lower(F.regexp_extract(l["m"], unit, 1)) == F.col("unit")) & (stop(l) <= F.col("_c.at")) & (F.size(values(l)) >= 3))
        nearest = F.array_max(F.transform(fitting, lambda l: F.struct(stop(l).alias("stop"), (-l["at"]).alias("neg"), l["m"].alias("m"))))
        rows = df.withColumn("_n", nearest).withColumn("numbers", F.transform(values(F.col("_n")), lambda v: v.try_cast("double")))
        rows = rows.withColumn("computed", F.when(F.size("numbers") > 0, F.aggregate("numbers", F.lit(0.0), lambda a, v: a + v) / F.size("numbers"))).drop("_n")
        ok = F.abs(F.col("computed") - F.col("reported")) <= F.greatest(F.lit(0.05), 0.05 * F.abs("reported"))
        return rows.withColumn("consistent", ok).withColumn("calculation", average_calculation())

    def find(df: DataFrame) -> DataFrame:
        both = df.withColumn("_t", repair_decimals(F.col("text"))).where(F.col("_t").rlike(claim))
        both = both.withColumn("_l", matches_with_offsets(F.col("_t"), listed)).select(*df.columns, "_l", F.size("_l").alias("_lists"), F.posexplode(matches_with_offsets(F.col("_t"), claim)).alias("_k", "_c"))
        both = both.withColumn("unit", mine).withColumn("reported", F.regexp_extract("_c.m", rf"(?i)({_NUM})\s*(?:{UNITS_AVERAGE})$", 1).try_cast("double"))
        return against(both, F.col("_l"))

    def number(df: DataFrame) -> DataFrame:
        by_place = W.partitionBy(document).orderBy(*order, "_k")
        both = df.withColumn("claim", F.row_number().over(by_place))
        used = F.coalesce(F.sum(F.when(F.col("claim") <= budget, F.col("_lists")).otherwise(0)).over(by_place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        both = both.withColumn("_used", used).withColumn("_place", F.struct(*order))
        trip = F.min(F.when(F.col("_used") + F.col("_lists") > lists, F.col("_place"))).over(W.partitionBy(document))
        both = both.withColumn("_tripped", F.coalesce((F.col("_place") > trip).cast("int"), F.lit(0)))
        both = both.withColumn("examined", (F.col("claim") <= budget) & (F.col("_tripped") == 0)).drop("_place", "_tripped")
        return both.withColumn("compared", F.when(F.col("examined"), F.least(F.col("_lists"), F.greatest(F.lit(0), lists - F.col("_used")))).otherwise(0).cast("int"))

    rows = by_text(blocks, find, ["_lists"], number)
    made, whole = ["numbers", "computed", "consistent", "calculation"], F.col("compared") == F.col("_lists")
    rows = against(rows.withColumns({f"_all_{c}": F.col(c) for c in made}), F.when(~whole, F.slice("_l", F.lit(1), F.col("compared"))))
    numbers, computed, consistent, calculation = (F.when(whole, F.col(f"_all_{c}")).otherwise(F.col(c)).alias(c) for c in made)
    return rows.select(*keep, "claim", "examined", "compared", "_lists", "unit", numbers, computed, "reported", consistent, calculation, F.col("_c.m").alias("marker"))


def average_checks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., unit, n_values, computed, reported, consistent): every reported average that has a list, without budgets."""
    c = average_claims(blocks.select(*keys, "text"), keys[0], keys[1:] or keys[:1], budget=2**31 - 1, lists=2**31 - 1)
    return c.where("computed is not null").select(*keys, "unit", F.size("numbers").alias("n_values"), "computed", "reported", "consistent")


def average_calculation() -> Column:
    """The disclosed calculation of an average."""
    return F.concat(F.lit("mean("), F.array_join(F.transform("numbers", general), ", "), F.lit(") = "), general(F.col("computed")), F.lit("; reported ≈ "), general(F.col("reported")), F.lit(" "), F.col("unit"))


def citation_contexts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., context, ordinals, at): the sentence around each citation bracket that holds an ordinal; of equal ones in a block the first.

    Found and made distinct inside the row, so nothing is shuffled.
    """
    return found_citations(blocks).select(*keys, "context", "ordinals", "at")


def found_citations(blocks: DataFrame) -> DataFrame:
    """The blocks' columns with (_k, context, ordinals, at) of each of their citation contexts."""

    def context(m: Column) -> Column:
        inside = citation_ordinals(F.regexp_replace(m["m"], r"^\[|\]$", ""))
        return F.struct(sentence_around(F.col("text"), m["at"], m["at"] + F.length(m["m"])).alias("context"), inside.alias("ordinals"), m["at"].alias("at"))

    found = blocks.where(F.contains("text", F.lit("["))).withColumn("_c", F.filter(F.transform(matches_with_offsets(F.col("text"), r"\[[^\]]+\]"), context), lambda c: F.size(c["ordinals"]) > 0))
    fresh = F.filter("_c", lambda c, i: ~F.exists(F.slice("_c", F.lit(1), i), lambda d: (d["context"] == c["context"]) & (d["ordinals"] == c["ordinals"])))
    return found.select(*blocks.columns, F.posexplode(fresh).alias("_k", "_d")).select(*blocks.columns, "_k", "_d.context", "_d.ordinals", "_d.at")


def measurement_contexts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., text, at, value, unit, condition, marker, terms): every measurement with the nearest condition within 90 characters.

    'A and B u at X and Y, respectively' binds (A, X) and (B, Y) and keeps its
    measurements from binding otherwise.  ``at`` orders a block's rows: parallel
    ones first (negative), then by place.
    """

    def find(df: DataFrame) -> DataFrame:
        return _measured(df, [c for c in df.columns if c != "text"]).withColumn("_k", F.col("at"))  # a text's measurements differ in their places

    return by_text(blocks.select(*dict.fromkeys([*keys, "text"])), find, []).select(*keys, "text", "at", "value", "unit", "condition", "marker", "terms")


def _measured(blocks: DataFrame, keys: list[str]) -> DataFrame:
    cond, unit = CONDITION, UNITS_MEASURED
    parallel = rf"(?i){_NUM}\s+(?:and|,)\s+{_NUM}\s*(?:{unit})\s+at\s+(?:{cond})\s+and\s+(?:{cond})\s*,?\s*respectively"
    measure = rf"(?i){_NUM}\s*(?:{unit})(?![A-Za-z])"
    base = blocks.select(*keys, "text", matches_with_offsets(F.col("text"), parallel).alias("_p"), matches_with_offsets(F.col("text"), rf"(?i){cond}").alias("_c"))

    def terms(start: Column, end: Column) -> Column:
        raw = F.regexp_extract_all(F.lower(sentence_around(F.col("text"), start, end)), F.lit(r"([a-z]{4,})"), F.lit(1))
        cut = F.transform(raw, lambda w: F.when(w.endswith("s") & (F.length(w) > 5), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))
        return F.array_sort(F.array_distinct(F.filter(cut, lambda w: ~w.isin(CONTEXT_STOP))))

    single = base.withColumn("_m", F.explode(matches_with_offsets(F.col("text"), measure)))
    single = single.where(~F.exists("_p", lambda p: (p["at"] <= F.col("_m.at")) & (F.col("_m.at") < p["at"] + F.length(p["m"]))))
    a, b = F.col("_m.at"), F.col("_m.at") + F.length("_m.m")
    near = F.filter("_c", lambda c: (c["at"] >= a - 90) & (c["at"] + F.length(c["m"]) <= b + 90))
    best = F.array_min(F.transform(near, lambda c: F.struct(F.abs(2 * c["at"] + F.length(c["m"]) - a - b).alias("d"), c["at"].alias("at"), c["m"].alias("m"))))
    single = single.select(*keys, "text", a.alias("at"), F.regexp_extract("_m.m", rf"^({_NUM})", 1).alias("value"), F.lower(F.regexp_extract("_m.m", rf"(?i)({unit})$", 1)).alias("unit"), best["m"].alias("condition"), F.col("_m.m").alias("marker"), terms(a, b).alias("terms"))
    pair = base.withColumn("_m", F.explode("_p"))
    a, b = F.col("_m.at"), F.col("_m.at") + F.length("_m.m")
    values = F.regexp_extract_all("_m.m", F.lit(rf"({_NUM})"), F.lit(1))
    conditions = F.regexp_extract_all("_m.m", F.lit(rf"(?i)(?:at|and)\s+({cond})"), F.lit(1))
    pair = pair.select(*keys, "text", a.alias("_at"), F.col("_m.m").alias("marker"), F.lower(F.regexp_extract("_m.m", rf"(?i)({unit})\s+at\s", 1)).alias("unit"), terms(a, b).alias("terms"), F.posexplode(F.arrays_zip(F.slice(values, 1, 2).alias("v"), F.slice(conditions, -2, 2).alias("c"))).alias("i", "z"))
    pair = pair.select(*keys, "text", (2 * F.col("_at") + F.col("i") - 2**30).alias("at"), F.col("z.v").alias("value"), "unit", F.col("z.c").alias("condition"), "marker", "terms")
    return single.where("condition is not null").unionByName(pair)


def condition_conflicts(contexts: DataFrame, document: str, order: list[str]) -> DataFrame:
    """(document, value, unit, n_conditions, conditions, baseline, subject, source): values of a document under several conditions in comparable contexts.

    Of the pairs that stand under different conditions and share a context
    term, the one with most in common is taken, the first of equal ones.  The
    baseline is the most frequent condition, the first seen of equal ones; the
    member under it is the source, else the earlier.  Measurements of one
    condition with the same terms have as much in common with any other, so
    only the first of them is paired.  A group lies within one document, so it
    is bounded by that document's text.
    """
    c = contexts.withColumn("_c", F.lower("condition"))
    seen = c.groupBy(document, "value", "unit", "_c").agg(F.count("*").alias("_n"), F.min(F.struct(*order, "at")).alias("_first"))
    base = seen.groupBy(document, "value", "unit").agg(F.count("*").cast("int").alias("n_conditions"), F.array_sort(F.collect_list("_c")).alias("conditions"), F.min_by("_c", F.struct((-F.col("_n")).alias("n"), "_first")).alias("baseline")).where("n_conditions >= 2")
    item = F.struct(F.struct(*order, "at").alias("o"), F.col("_c").alias("c"), "terms", "text", "marker")
    firsts = c.groupBy(document, "value", "unit", "_c", "terms").agg(F.min(item).alias("_x"))
    rows = firsts.join(base, [document, "value", "unit"]).groupBy(document, "value", "unit").agg(F.array_sort(F.collect_list("_x")).alias("_i"), F.first("n_conditions").alias("n_conditions"), F.first("conditions").alias("conditions"), F.first("baseline").alias("baseline"))
    pairs = F.flatten(F.transform("_i", lambda x, i: F.transform(F.filter(F.slice("_i", i + 2, F.size("_i")), lambda y: (y["c"] != x["c"]) & F.arrays_overlap(x["terms"], y["terms"])), lambda y: F.struct((-F.size(F.array_intersect(x["terms"], y["terms"]))).alias("shared"), x["o"].alias("a"), y["o"].alias("b")))))
    best = rows.withColumn("_best", F.array_min(pairs)).where("_best is not null")
    left, right = (F.filter("_i", lambda x: x["o"] == F.col(f"_best.{k}"))[0] for k in "ab")
    swap = (F.col("_r.c") == F.col("baseline")) & (F.col("_l.c") != F.col("baseline"))
    best = best.withColumn("_l", left).withColumn("_r", right)
    return best.select(document, "value", "unit", "n_conditions", "conditions", "baseline", F.when(swap, F.col("_l")).otherwise(F.col("_r")).alias("subject"), F.when(swap, F.col("_r")).otherwise(F.col("_l")).alias("source"))
