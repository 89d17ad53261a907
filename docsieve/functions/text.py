"""Text expressions: tokens, stems, numbers, citation marks, sentences.  All JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the result contract: stop words, polarity words, negators.
STOPWORDS = (
    "about after also been before between could from have into more other over paper results study than that their these this through under using were which with would"
).split()
UP_WORDS = "increase increased increases higher raise raised rise rose".split()
DOWN_WORDS = "decrease decreased decreases lower reduce reduced decline declined".split()
NEGATORS = "not no never".split()


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def compact(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, underscore, apostrophe and hyphen."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_'-]+)"), F.lit(1))


def stems(tokens: Column) -> Column:
    """Light stems of the tokens, stop words and words under three letters left out; the first rule that fits applies."""
    kept = F.filter(tokens, lambda w: (F.length(w) >= 3) & ~F.array_contains(F.expr(_array(STOPWORDS)), w))

    def stem(w: Column) -> Column:
        n = F.length(w)

        def cut(k: int) -> Column:
            return F.substr(w, F.lit(1), n - k)

        return (
            F.when(w.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
            .when(w.endswith("ing") & (n > 6), cut(3))
            .when(w.endswith("ed") & (n > 5), cut(2))
            .when(w.endswith("s") & (n > 5), cut(1))
            .otherwise(w)
        )

    return F.transform(kept, stem)


def number_strings(text: Column) -> Column:
    """Distinct numbers outside citation brackets, sorted as strings."""
    bare = F.regexp_replace(text, r"\[[^\]]+\]", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"((?<![A-Za-z])\d+(?:\.\d+)?)"), F.lit(1))))


def citation_ordinals(body: Column) -> Column:
    """Sorted distinct ordinals of one citation bracket; ranges of at most a hundred steps are expanded."""
    parts = F.transform(F.split(F.regexp_replace(body, "–", "-"), r"[,;]"), lambda p: F.trim(p))

    def expand(p: Column) -> Column:
        one = p.rlike(r"^\d{1,9}$")
        span = p.rlike(r"^\d{1,9}\s*-\s*\d{1,9}$")
        low = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
        high = F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")
        none = F.array().cast("array<int>")
        return F.when(one, F.array(low)).when(span & (high >= low) & (high - low <= 100), F.sequence(low, high)).otherwise(none)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """Array of (m, at): every match of ``pattern`` with its 0-based start.

    The gaps between the matches and the matches themselves are found once each
    and folded together: a match starts where all before it ends.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<m:string,at:int>>)")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["g"])
        more = F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), at.alias("at"))))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct((at + F.length(x["m"])).alias("at"), more.alias("out")))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence that spans [start, end): from after the last '. ' before it to the first '. ' after it, the period kept."""
    before = F.substr(text, F.lit(1), start)
    left = F.length(before) - F.coalesce(F.nullif(F.locate(" .", F.reverse(before)), F.lit(0)) - 1, F.length(before))
    rest = F.substr(text, end + 1, F.length(text))
    right = F.when(F.locate(". ", rest) > 0, end + F.locate(". ", rest)).otherwise(F.length(text))
    return F.trim(F.substr(text, left + 1, right - left))


def excerpt_around(text: Column, marker: Column, radius: int = 260) -> Column:
    """``radius`` characters around the first occurrence of the marker in any case; the whole text where it is short or has none."""
    at = F.position(F.lower(marker), F.lower(text))
    start = F.greatest(F.lit(0), at - 1 - radius)
    end = F.least(F.length(text), at - 1 + F.length(marker) + radius)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substr(text, start + 1, end - start)), F.when(end < F.length(text), "…").otherwise(""))
    return F.when((F.length(text) <= 2 * radius) | (at == 0), text).otherwise(cut)  # short texts aren't searched


WORD = r"[\p{L}\p{N}_'-]+"


def word_excerpt(text: Column, start: Column, count: Column) -> Column:
    """The text from the first to the last of ``count`` words, the first being number ``start`` from 0, as it stands."""
    m = matches_with_offsets(text, WORD)
    first, last = F.try_element_at(m, (start + 1).cast("int")), F.try_element_at(m, F.least(start + count, F.size(m)).cast("int"))
    return F.substr(text, first["at"] + 1, last["at"] + F.length(last["m"]) - first["at"])


def repair_decimals(text: Column) -> Column:
    """'0 .05' becomes '0.05'."""
    return F.regexp_replace(text, r"(?<=\d)\s+\.\s*(?=\d)", ".")


# Fixed values of the result contract: what may stand before a DOI.
DOI_LEAD = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"


def doi(value: Column) -> Column:
    """Bare lower-cased DOI; empty becomes null."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(value), DOI_LEAD, "")), F.lit(""))


def general(number: Column) -> Column:
    """Shortest form of a number: six significant digits, no trailing zeros; for magnitudes from 1e-4 to 1e6."""
    places = 5 - F.floor(F.log10(F.greatest(F.abs(number), F.lit(1e-4)))).cast("int")
    scale = F.pow(F.lit(10.0), places)
    shown = F.call_function("format_number", F.rint(number * scale) / scale, F.lit("0.#########"))
    return F.when(number == 0, "0").otherwise(shown)


def direction_event(w: Column) -> Column:
    """struct(state, polarity, predicate) of a text's words: 'none', 'ambiguous' or 'event' with its polarity and predicate words.

    Exactly one polarity word whose next four words hold a predicate, and no
    negator among the three words before any, makes an event.
    """
    up, down, neg, stop = (F.expr(_array(x)) for x in (UP_WORDS, DOWN_WORDS, NEGATORS, STOPWORDS))

    def is_polar(x: Column) -> Column:
        return F.array_contains(up, x) | F.array_contains(down, x)

    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.coalesce(is_polar(F.try_element_at(w, i)), F.lit(False)))
    negated = F.exists(at, lambda i: F.arrays_overlap(F.slice(w, F.greatest(F.lit(1), i - 3), F.least(F.lit(3), i - 1)), neg))
    first = F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(1))
    predicate = F.array_distinct(F.filter(F.slice(w, first + 1, 4), lambda x: ~F.array_contains(stop, x) & ~is_polar(x) & ~x.rlike(r"^\d+$")))
    state = F.when(F.size(at) == 0, "none").when(negated | (F.size(at) > 1) | (F.size(predicate) == 0), "ambiguous").otherwise("event")
    polarity = F.when(F.array_contains(up, F.try_element_at(w, first)), 1).otherwise(-1)
    return F.struct(state.alias("state"), polarity.alias("polarity"), predicate.alias("predicate"))


def direction_relation(subject: Column, source: Column) -> Column:
    """'none', 'aligned', 'conflict' or 'ambiguous' for two direction events."""
    a, b = subject["state"], source["state"]
    return (
        F.when((a == "ambiguous") | (b == "ambiguous"), "ambiguous")
        .when((a == "none") & (b == "none"), "none")
        .when((a == "none") | (b == "none"), "ambiguous")
        .when(~F.arrays_overlap(subject["predicate"], source["predicate"]), "ambiguous")
        .when(subject["polarity"] != source["polarity"], "conflict")
        .otherwise("aligned")
    )
