"""Several values packed in one field: infer the delimiter, split, explode.

``split_packed`` turns a string column that packs several names into one row
per name.  Delimiters differ from source to source and the values may be
quoted, so the delimiters are inferred.  Each row scores combinations of the
delimiters that occur in it on how regular the resulting pieces are (do they
look like a person, an inverted person or an organisation?).  Per source these
scores are added up: how regular a combination is, how consistent its number of
pieces is, and in how many of the source's rows it is the best.  A row is split
by the combination with the best sum of its own score and its source's; where
several fit a row alike, its source decides.

Defined results: null, empty and blank strings give no row; empty places are
skipped and don't count as a position; a value repeated inside one string is
kept (positions differ); text of any length is processed whole; rows without a
source form one source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Delimiter classes, quote pairs, words that mark organisations.
DELIMITERS = {
    "newline": r"\s*(?:\r\n|\r|\n)\s*",
    "semicolon": r"\s*(?:(?<!&amp);|；)\s*",
    "pipe": r"\s*[|｜]\s*",
    "tab": r"\s*\t\s*",
    "slash": r"\s*[/／]\s*",
    "bullet": r"\s*[•·]\s*",
    "ideographic": r"\s*、\s*",
    "widecomma": r"\s*，\s*",
    "ampersand": r"\s*(?:&amp;|[&＆])\s*",
    "word": r"\s+(?:and|AND|und|UND|et|ET|y|e|with|och|en)\s+|\s*[和与及]\s*",
    "comma": r"\s*,\s*",
    "numbered": r"(?:^|\s+)[\(\[]\d{1,3}[\)\]]\s*|\s+\d{1,3}[.)]\s+",
}
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
ORG_WORDS = (
    "centre center ctr institute inst department dept laboratory lab university univ school college faculty academy hospital "
    "society association council agency office group team consortium committee network foundation museum library observatory "
    "institut zentrum abteilung universität instituto departamento laboratorio universidad laboratoire centro université"
).split()
ORG_TAILS = "studies sciences science research engineering technology medicine methods systems physics chemistry ecology statistics".split()
PARTICLES = "van von de der den di da del la le du dos al el bin ibn ter ten".split()

_ORG = re.compile(rf"(?i)\b(?:{'|'.join(ORG_WORDS)})\b|\b(?:{'|'.join(ORG_TAILS)})\b")
_ORG_HEAD = re.compile(rf"(?i)\b(?:{'|'.join(ORG_WORDS)})\b\.?")
_TAIL = re.compile(rf"(?i)\b(?:{'|'.join(ORG_TAILS)})\b")
_NUMBERING = re.compile(r"^\s*(?:[\(\[]\s*\d{1,3}\s*[\)\]]|\d{1,3}\s*[.):])\s*(?=\D)")
_ACRONYM = re.compile(r"[A-Z]{3,}(?:\s+\w[\w'’.-]*){0,3}$")
_INITIALS = re.compile(r"(?:[^\W\d_](?:\.\s?-?|[\s-]|$)){1,4}$|[A-ZÀ-Þ]{1,3}$")
_ET_AL = re.compile(r"(?i)\bet\s+al\b\.?|等$")
_SPLIT = {k: re.compile(v) for k, v in DELIMITERS.items()}
_WORD = re.compile(r"[^\W\d_](?:[\w'’`.-]*)")
_QUOTED, _HIDDEN = "\ud800", "\ud801"  # stand for what is masked, in order; no string of a table can hold half a surrogate pair
_CLOSED = re.compile(r"\s*(?:$|[;；|｜\t\r\n/／•·、，,&＆和与及]|(?:and|und|et|y|e|with|och|en)\s)")


def _mask_quotes(text: str) -> tuple[str, list[str]]:
    """Quoted values (at the start of a place, closing before the next) become one ``_QUOTED`` each."""
    out, kept, i, at_start = [], [], 0, True
    while i < len(text):
        ch = text[i]
        close = QUOTES.get(ch)
        if at_start and close:
            j, found = i + 1, -1
            while (j := text.find(close, j)) >= 0:
                if text[j : j + 2] == close * 2:
                    j += 2
                    continue
                if _CLOSED.match(text, j + 1):
                    found = j
                    break
                j += 1
            if found > 0 and text[i + 1 : found].strip():
                out.append(_QUOTED)
                kept.append(text[i + 1 : found].replace(close * 2, close))
                i, at_start = found + 1, False
                continue
        out.append(ch)
        if ch in ";；|｜\t\r\n/／•·、，,&＆和与及":
            at_start = True
        elif ch.isspace():
            at_start = at_start or bool(re.search(r"(?:^|\s)(?:and|und|et|y|e|with|och|en)$|^\s*\d{1,3}[.)]$|[\s,;]\d{1,3}[.)]$", "".join(out[-9:-1])))
        else:
            at_start = False
        i += 1
    return "".join(out), kept


_PROTECT = re.compile(
    rf"(?i)\b(?:{'|'.join(ORG_WORDS)})\b\.?(?:(?!\s(?:and|und|et|y)\s)[^,;|/\n&])*?\s(and|&amp;|&|und|et|y)\s[^,;|/&\n]*?\b(?:{'|'.join(ORG_TAILS)})\b"
)


def _protect_orgs(text: str) -> tuple[str, list[str]]:
    """An 'and' inside 'Centre of X and Y Studies' doesn't delimit: each such word becomes one ``_HIDDEN``."""
    words: list[str] = []

    def hide(m: re.Match) -> str:
        inner = m.group(0)
        words.append(m.group(1))
        return inner[: m.start(1) - m.start()] + _HIDDEN + inner[m.end(1) - m.start() :]

    return _PROTECT.sub(hide, text), words


@lru_cache(maxsize=65536)
def piece_score(piece: str, delims: str = ";；|｜\n\t/／•·、，&＆") -> float:
    """How much a piece looks like one author: 1 person or organisation, less for what remains unsplit or is a fragment."""
    p = piece.strip()
    if not p:
        return -1.0  # an empty place is skipped, not scored
    if p == _QUOTED:
        return 1.0
    if any(c in p for c in delims) or _SPLIT["numbered"].search(p):
        return 0.0
    if _ORG.search(p):
        head, tail = _ORG_HEAD.search(p), _TAIL.search(p)
        if p.count(",") > 1:
            return 0.1
        if not head and tail and len(p.split()) <= 2:
            return 0.3
        if re.search(r"(?:^|\s)(?:and|und|et|y)\s", p):
            return 0.1
        if "," in p:
            before, after = (x.strip() for x in p.split(",", 1))
            if not _ORG.search(before) or len(after.split()) > 3:
                return 0.1
            if _INITIALS.fullmatch(after):
                return 0.1
        return 1.0
    if re.search(r"\s(?:and|und|et|y)\s", p, re.I):
        return 0.1
    if p.count(",") == 1:
        last, first = (x.strip() for x in p.split(",", 1))
        lw, fw = last.split(), first.split()
        if not lw or not fw:
            return 0.1
        core = [w for w in lw if w.lower() not in PARTICLES]
        if len(core) == 1 and len(fw) <= 3 and all(_WORD.match(w) or w.startswith(('"', "(")) for w in fw) and not (len(core[0].strip(".")) <= 1):
            given = [w for w in fw if len(w.strip(".")) > 1 and not w.startswith('"')]
            return 0.97 if len(given) <= 1 else 0.6
        return 0.1
    if "," in p:
        return 0.05
    words = p.split()
    if _ACRONYM.match(p):
        return 0.95
    if len(words) == 1:
        return 0.35
    if _INITIALS.fullmatch(p):
        return 0.15
    if len(words) == 2 and _INITIALS.fullmatch(words[1]) and len(words[0].strip(".")) > 1:
        return 0.95
    return 1.0 if len(words) <= 5 else 0.5


def _pieces(masked: str, delims: tuple[str, ...]) -> list[str]:
    parts = [masked]
    for d in delims:
        parts = [q for p in parts for q in _SPLIT[d].split(p)]
    return parts


def _present(masked: str) -> list[str]:
    return [d for d in DELIMITERS if _SPLIT[d].search(masked)]


@lru_cache(maxsize=4096)
def _subsets(present: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [c for n in range(len(present) + 1) for c in combinations(present, n)]


SOURCE_WEIGHT = 0.1  # what a source's habit counts beside a row's own regularity
EXHAUSTIVE = 6  # kinds of delimiters in one string up to which every combination is scored


def _mask(text: str) -> tuple[str, list[str], list[str]]:
    masked, quoted = _mask_quotes(text)
    masked, words = _protect_orgs(masked)
    return masked, quoted, words


def _scores(masked: str) -> dict[tuple[str, ...], tuple[float, int]]:
    """For combinations of the delimiters that occur: mean regularity of the pieces and their number.

    All of them up to ``EXHAUSTIVE`` kinds; beyond, those of two kinds and from
    the best of these on every combination that adds the best further kind.
    """
    out: dict[tuple[str, ...], tuple[float, int]] = {}

    def score(s: tuple[str, ...]) -> None:
        pieces = [_NUMBERING.sub("", p) for p in _pieces(masked, s)]
        scores = [x for p in pieces if (x := piece_score(_ET_AL.sub("", p))) >= 0]
        if scores:
            out[s] = (sum(scores) / len(scores), len(scores))

    present = tuple(_present(masked))
    if len(present) <= EXHAUSTIVE:
        for s in _subsets(present):
            score(s)
        return out
    for n in range(3):
        for s in combinations(present, n):
            score(s)
    while out:
        best = choose(out)
        new = [s for d in present if d not in best and (s := tuple(x for x in present if x in best or x == d)) not in out]
        for s in new:
            score(s)
        if choose(out) == best:
            break
    return out


def score_subsets(text: str) -> dict[tuple[str, ...], tuple[float, int]]:
    """The scores of a text as it stands."""
    return _scores(_mask(text)[0])


def choose(scores: dict[tuple[str, ...], tuple[float, int]], prior: dict[tuple[str, ...], float] | None = None) -> tuple[str, ...]:
    """The combination with the most regular pieces; among equals the fewest delimiters, then the earliest in DELIMITERS."""
    prior = prior or {}
    order = list(DELIMITERS)
    return max(scores, key=lambda s: (round(scores[s][0] + SOURCE_WEIGHT * prior.get(s, 0.0), 6), -len(s), [-order.index(d) for d in s]))


_AROUND = "\ufeff \t\r\n\xa0"


def split_value(text: str | None, prior: dict[tuple[str, ...], float] | None = None) -> list[str]:
    """The values packed in ``text``, in order, empty places skipped."""
    if not text or not text.strip():
        return []
    masked, kept, hidden = _mask(text.strip(_AROUND))
    scores = _scores(masked)
    if not scores:
        return []
    quoted, words = iter(kept), iter(hidden)
    out = []
    for p in _pieces(masked, choose(scores, prior)):
        p = _NUMBERING.sub("", p.strip())
        p = re.sub(_HIDDEN, lambda _: next(words), p).strip().strip(",;|/&").strip()
        p = next(quoted).strip() if p == _QUOTED else re.sub(_QUOTED, lambda _: f'"{next(quoted)}"', p)
        p = re.sub(r"^(?:and|und|et|y)\s+(?=\S)", "", p, flags=re.I).strip()
        p = re.sub(r"\s*\bet\s+al\b\.?$", "", p, flags=re.I).strip()
        if p and re.search(r"\w", p):
            out.append(p)
    return out


def source_scores(df: DataFrame, packed: str, source: str) -> DataFrame:
    """(source, delims, prior): what speaks for each combination of delimiters in each source.

    The share of the source's rows in which it is the best, times its mean
    regularity there less a tenth of the relative spread of the number of
    pieces.  Sums only, combined map-side, so a source with most of the rows
    costs no more.
    """

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, name, reg, n, best = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = score_subsets((text or "").strip(_AROUND))
                first = choose(found) if found else None
                for s, (r, c) in found.items():
                    at.append(i), name.append("+".join(s)), reg.append(r), n.append(float(c)), best.append(s == first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, t) for v, t in ((name, pa.string()), (reg, pa.float64()), (n, pa.float64()), (best, pa.bool_()))]], names=["_src", "delims", "reg", "n", "best"])

    kind = df.schema[source].dataType.simpleString()
    each = df.where(F.col(packed).isNotNull()).select(F.col(source).alias("_src"), F.col(packed).alias("_packed")).mapInArrow(scores, f"_src {kind}, delims string, reg double, n double, best boolean")
    sums = each.groupBy("_src", "delims").agg(F.avg(F.when(F.col("best"), F.col("reg"))).alias("reg"), F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"), F.count_if("best").alias("won"))
    rows = F.greatest(F.sum("won").over(W.partitionBy("_src")), F.lit(1))  # each row has one best; a source has as many sums as combinations
    return sums.withColumn("rows", rows).select(F.col("_src").alias(source), "delims", F.expr("coalesce(won / rows * (reg - 0.1 * sd / greatest(m, 1)), 0.0)").alias("prior"))


def split_packed(df: DataFrame, key: str, packed: str, *, source: str | None = None, value_name: str = "author") -> DataFrame:
    """(key, pos, value): one row for each value in ``packed``.

    ``source`` names the column whose rows share a notation; what
    ``source_scores`` finds for it is joined back by source, never collected.
    Without it each string is its own source.
    """
    rows = df.where(F.col(packed).isNotNull())
    if source is None:
        given = rows.select(F.col(key).alias("_k"), F.col(packed).alias("_packed"), F.lit(None).cast("map<string,double>").alias("_prior"))
    else:
        prior = source_scores(df, packed, source).groupBy(F.col(source).alias("_src")).agg(F.map_from_entries(F.collect_list(F.struct("delims", "prior"))).alias("_prior"))  # at most the combinations of DELIMITERS
        given = rows.select(F.col(key).alias("_k"), F.col(packed).alias("_packed"), F.col(source).alias("_s")).join(prior, F.col("_s").eqNullSafe(F.col("_src")), "left").select("_k", "_packed", "_prior")
    kind = df.schema[key].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        for b in batches:
            keys, pos, vals = [], [], []
            for i, (text, entries) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                p = None
                if entries:
                    entries = tuple(entries)
                    if entries not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[entries] = {tuple(x for x in k.split("+") if x): v for k, v in entries}
                    p = known[entries]
                for n, v in enumerate(split_value(text, p), 1):
                    keys.append(i), pos.append(n), vals.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(pos, pa.int32()), pa.array(vals, pa.string())], names=[key, "pos", value_name])

    return given.mapInArrow(explode, f"`{key}` {kind}, pos int, `{value_name}` string")
