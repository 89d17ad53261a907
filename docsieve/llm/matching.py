"""Matching records of two sources without a common key (problem 4).

A deterministic cascade of exact joins, each on a weaker combination of
attributes than the one before; records that a pass resolves leave the next
passes by an anti-join.

1. title and pages
2. title, year (one off at most) and a name
3. title and one of year or name, or title where the rest is missing
4. pages, year and a name, the titles alike
5. title with up to two words damaged or missing, with pages, name or year

Titles are compared as word sequences without case, accents and punctuation;
the part of a series and marks such as "Correction to" are kept apart and must
agree.  Titles that share all but two of their words share one of the three
rarest words of each, so pass 5 joins exactly on those: rare by the catalogue's
own counts, hence no word of many titles.  A title of which more than two words
stand nowhere in the catalogue leaves before the join.  The differing words are
checked afterwards.

The confidence of a rule is its labelled precision with smoothing,
``(agreeing + 1) / (labelled + 2)``.  A match is labelled by the container
(journal), which no rule uses: its words must begin alike, so abbreviations
agree.  Where one side states none, the match has no label.  Catalogue records
of one work are found by title and a further attribute, and all count.

Defined results: a citation without a usable title is matched by its raw text
alone; records without a title have no twins and match nothing; null attributes
neither support nor contradict; repeated rows of a reference give one row; an
empty side gives no rows; without labels a rule's confidence is 0.5.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.sources.settle import settle

BROADCAST_ROWS = 200_000  # rows of a written list up to which it is sent to the executors; counted on what is sent
DIFFERING = 2  # words of a title that may be damaged or missing

# What may lead or end a title without being part of it, and what marks another work.
NOISE = ["technical report", "research article", "original article", "review article", "article", "preprint", "online first", "working paper", "full text", "abstract", "in press"]
MARKS = ["correction to", "corrigendum to", "corrigendum", "erratum to", "erratum", "addendum to", "addendum", "comment on", "comments on", "a comment on", "reply to", "a reply to", "response to", "retraction of", "discussion of", "review of"]
_PART = re.compile(r" (part|pt|teil|partie|parte|volume|vol|band|book|series|supplement|chapter) ([ivx]{1,4}|\d{1,2}|one|two|three|four)$")
_END_MARK = re.compile(r" (?:a |the )?(correction|erratum|comment|reply|response|addendum|corrigendum|rejoinder|commentary)$")
_NOISE_END = re.compile(rf" (?:{'|'.join(NOISE)})$")
_MARK_START = re.compile(rf"^({'|'.join(sorted(MARKS, key=len, reverse=True))}) ")


_ASCII_WORDS = re.compile(r"[a-z0-9]+")
_WORDS = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­¬]\s+(?=[a-z])")
_COMBINING = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))) + "]+")
_ET_AL = re.compile(r"\bet\.? al|等|and others|u\. ?a\.")


def fold(text: str | None) -> str:
    """Lower case, no accents, words separated by one space."""
    if not text:
        return ""
    if text.isascii():
        t = text.replace("&", " and ")
        return " ".join(_ASCII_WORDS.findall((_BROKEN.sub("", t) if "-" in t else t).lower()))
    t = unicodedata.normalize("NFKD", text.replace("&", " and ").replace("ø", "o").replace("Ø", "O").replace("ß", "ss"))
    return " ".join(_WORDS.findall(_COMBINING.sub("", _BROKEN.sub("", t).lower())))


def read_title(title: str | None) -> tuple[str, str]:
    """(base, mark) of a title: its words, and what tells it from other works of that name."""
    t = fold(title)
    marks = []
    while True:
        before = t
        t = _NOISE_END.sub("", t)
        if m := _MARK_START.match(t):
            marks.append(m.group(1).split()[0] if m.group(1).split()[0] != "a" else m.group(1).split()[1])
            t = t[m.end() :]
        if m := _PART.search(t):
            marks.append(f"{m.group(1)} {m.group(2)}")
            t = t[: m.start()]
        if m := _END_MARK.search(t):
            marks.append(m.group(1))
            t = t[: m.start()]
        if t == before:
            return t, " ".join(sorted(marks))


_STYLES = [
    re.compile(r"^(.+?)\s+/\s+.+?\s+//\s"),
    re.compile(r"[\"“]([^\"“”]{15,}?)[,.]?[\"”]\s*,?"),
    re.compile(r"\(\d{4}[a-z]?\)\.\s+(.+?)(?:\.|(?<=\?)|\*)\s+[A-ZÀ-Þ][^.]*?(?:\.\s[A-ZÀ-Þ][^.]*?)*\.?,\s*\d"),
    re.compile(r"^[^:]{3,}?:\s+(.+?)\.\s+In:\s"),
]
_TAIL = re.compile(r"(?:\[[A-Z](?:/[A-Z]{1,2})?\]\.?\s.*|\.{1,2}\s+\d{4}[a-z]?;.*)$")
_ABBREVIATED = re.compile(r"\.\s+(?:[A-ZÀ-Þ][\w'’]{0,7}\.?\s?){2,7}$")


def title_of(raw: str | None) -> str | None:
    """The title inside a raw citation: by the styles of citing, else the last part before the container that has four words."""
    if not raw:
        return None
    s = re.sub(r"^\s*\[\d+\]\s*", "", re.sub(r"\s+", " ", raw)).strip()
    for style in _STYLES:
        if m := style.search(s):
            return m.group(1)
    tail = _TAIL.search(s)
    if tail:
        s = s[: tail.start()]
        if not tail.group().startswith("["):  # the container still stands before the year
            m = _ABBREVIATED.search(s)
            s = s[: m.start()] if m and "." in m.group()[2:] else re.sub(r"(?:\.|(?<=\?)|\*)\s+[^.?]+$", "", s)
    parts = [p for p in re.split(r"(?<=[^\W\d_]{2})\.{1,2}\s+|(?<=[)\]])\.{1,2}\s+|(?<=\s[A-ZÀ-Þ])\.{1,2}\s+(?=[A-ZÀ-Þ][^\W\d_]+[\s:])", s) if len(p.split()) >= 4]
    return parts[-1] if parts else None


def pages_of(raw: str | None) -> str | None:
    """First and last page, the last such pair of a citation."""
    found = re.findall(r"(?<![\d/])(\d{1,5})\s*[-–—]\s*(\d{1,5})(?!\d)", raw or "")
    return f"{int(found[-1][0])}-{int(found[-1][1])}" if found else None


def year_of(*values: object) -> int | None:
    for v in values:
        if m := re.search(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)", str(v or "")):
            return int(m.group(1))
    return None


def raw_year(raw: str | None) -> int | None:
    """The year of a raw citation; page numbers that look like one don't count."""
    return year_of(re.sub(r"\d+\s*[-–—]\s*\d+", " ", re.sub(r"^\s*\[\d+\]", "", raw or "")))


def names_in(folded: str) -> list[str]:
    """The words of folded text that may be names."""
    return sorted({w for w in folded.split() if len(w) >= 4 and not w.isdigit()})


def h64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def damerau(a: str, b: str, limit: int = 2) -> int:
    """Edit distance with transpositions, cut off above ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            new.append(d)
        two, row = row, new
        if min(row) > limit:
            return limit + 1
    return row[-1]


def alike(left: str, right: str) -> bool:
    """Whether two titles differ only by damage: every differing word is a misspelling, or up to two are missing in one of them."""
    a, b = left.split(), right.split()
    if not a or not b:
        return False
    for w in list(a):
        if w in b:
            a.remove(w)
            b.remove(w)
    if "".join(a) == "".join(b):
        return True
    for w in list(a):
        near = next((v for v in b if damerau(w, v) <= (2 if min(len(w), len(v)) >= 6 else 1) and min(len(w), len(v)) >= 3), None)
        if near is not None:
            a.remove(w)
            b.remove(near)
    return (not a or not b) and len(a) + len(b) <= DIFFERING


_FEATURES = "base string, mark string, whole bigint, year int, pages string, names array<string>, venue string"
_ARROW = [("base", pa.string()), ("mark", pa.string()), ("whole", pa.int64()), ("year", pa.int32()), ("pages", pa.string()), ("names", pa.list_(pa.string())), ("venue", pa.string())]


def _batch(keys: pa.Array, key: str, rows: list[tuple], venue: pa.Array) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_ARROW[:-1])]
    return pa.RecordBatch.from_arrays([keys, *columns, venue], names=[key, *[n for n, _ in _ARROW]])


def reference_features(refs: DataFrame) -> DataFrame:
    """What each reference is compared by."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, title, authors, year in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                usable = title if title and "…" not in title and not title.rstrip().endswith("...") else (title_of(raw) or title)
                base, mark = read_title(usable)
                stated = " ; ".join([a for a in authors or [] if a])
                names = names_in(fold(f"{stated} ; {raw or ''}" if not authors or _ET_AL.search(raw or "") else stated))
                rows.append((base, mark, h64(f"{mark}|{base}"), year_of(raw_year(raw), year), pages_of(raw), names))
            yield _batch(b.column(0), "reference_id", rows, b.column(5))

    venue = container_key(F.col("venue")) if "venue" in refs.columns else F.lit(None).cast("string")
    return refs.select(F.col("id").alias("reference_id"), "raw_citation", "title", "authors", "year", venue.alias("venue")).mapInArrow(read, f"reference_id string, {_FEATURES}")


def catalogue_features(works: DataFrame) -> DataFrame:
    """What each catalogue record is compared by."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for title, creators, year, pages in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                base, mark = read_title(title)
                rows.append((base, mark, h64(f"{mark}|{base}"), year, pages_of(pages), names_in(fold(creators))))
            yield _batch(b.column(0), "work_id", rows, b.column(5))

    venue = container_key(F.col("container")) if "container" in works.columns else F.lit(None).cast("string")
    return works.select("work_id", "title", "creators", F.col("pub_year").cast("int"), "pages", venue.alias("venue")).mapInArrow(read, f"work_id bigint, {_FEATURES}")


def container_key(name: Column) -> Column:
    """The first three letters of each word of a container's name, small words left out; null for none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}]+", " ")), " ")
    heads = F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "for", "der", "die", "das", "und", "für", "des", "del", "les")), lambda w: F.substr(w, F.lit(1), F.lit(3)))
    return F.nullif(F.array_join(heads, " "), F.lit(""))


def _near(df: DataFrame) -> DataFrame:
    """A written list, sent to the executors if its rows, which are counted, allow; joined by a shuffle beyond that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _check_titles(pairs: DataFrame) -> DataFrame:
    """Pairs whose titles differ only by damage."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(x or "", y or "") for x, y in zip(b.column("base").to_pylist(), b.column("c_base").to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(check, pairs.schema)


def _rare_words(titles: DataFrame, counts: DataFrame) -> DataFrame:
    """(whole, base, mark, n, word): of each title the words that a title sharing all but DIFFERING of them must hold one of."""
    words = titles.select("whole", "base", "mark", F.array_distinct(F.split("base", " ")).alias("_w"))
    known = words.select("whole", "base", "mark", F.size("_w").alias("n"), F.explode("_w").alias("word")).join(counts, "word")
    ranked = known.groupBy("whole", "base", "mark", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("_k"))  # at most the words of one title
    kept = ranked.withColumn("_most", F.size("_k") - F.col("n") + DIFFERING + 1).where("_most > 0")
    return kept.select("whole", "base", "mark", "n", F.explode(F.slice("_k", F.lit(1), F.col("_most"))).alias("k")).select("whole", "base", "mark", "n", "k.word")


def damaged_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(whole, c_whole): pairs of different titles of one mark that differ only by damage in up to DIFFERING words.

    Titles are one class first, so a title of many records is compared once.
    """
    mine, theirs = (df.where("base <> ''").select("whole", "base", "mark").distinct() for df in (left, right))
    theirs = settle(theirs, "match-titles")
    counts = settle(theirs.select(F.explode(F.array_distinct(F.split("base", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "match-words")
    counts = _near(counts)
    keys = settle(_rare_words(theirs, counts), "match-keys").toDF("c_whole", "c_base", "c_mark", "c_n", "word")
    both = _rare_words(mine, counts).join(_near(keys), "word").where("mark = c_mark and whole <> c_whole and abs(n - c_n) <= " + str(DIFFERING))
    common = F.size(F.array_intersect(F.split("base", " "), F.split("c_base", " ")))
    close = both.where(common >= F.greatest("n", "c_n") - DIFFERING).select("whole", "base", "c_whole", "c_base").distinct()
    return _check_titles(close).select("whole", "c_whole")


def match_records(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(reference_id, work_id, rule, confidence): all matches of the cascade."""
    left = settle(reference_features(refs), "match-references")
    right = settle(catalogue_features(works).distinct(), "match-works")
    c = _near(right.select("work_id", *[F.col(n).alias(f"c_{n}") for n, _ in _ARROW]))
    year = F.coalesce(F.abs(F.col("year") - F.col("c_year")) <= 1, F.lit(False))
    year_against = F.coalesce(F.abs(F.col("year") - F.col("c_year")) > 1, F.lit(False))
    name = F.coalesce(F.arrays_overlap("names", "c_names"), F.lit(False))
    names_missing = (F.size("names") == 0) | (F.size("c_names") == 0)
    pages = F.coalesce(F.col("pages") == F.col("c_pages"), F.lit(False))
    same_pages = F.col("pages") == F.col("c_pages")  # as an equation, so it is a key of the join
    titled = (F.col("whole") == F.col("c_whole")) & (F.col("base") != "")

    def damaged(rest: DataFrame) -> DataFrame:
        pairs = settle(damaged_titles(rest, right), "match-damaged")
        both = rest.join(_near(pairs), "whole").join(c, "c_whole")
        return both.where(pages | name | year).where(~year_against | pages)

    passes = [
        lambda rest: rest.join(c, titled & same_pages),
        lambda rest: rest.join(c, titled & year & name),
        lambda rest: rest.join(c, titled & (year | (name & ~year_against) | (~year_against & names_missing))),
        lambda rest: _check_titles(rest.join(c, same_pages & (F.col("mark") == F.col("c_mark")) & year & name)),
        damaged,
    ]
    label = F.col("venue") == F.col("c_venue")
    rest, found = left, None
    for number, step in enumerate(passes, 1):
        hits = settle(step(rest).select("reference_id", "work_id", label.alias("label"), F.lit(number).alias("rule")).distinct(), f"match-pass{number}")
        found = hits if found is None else found.unionByName(hits)
        if number < len(passes):
            rest = rest.join(hits.select("reference_id").distinct(), "reference_id", "left_anti")
    precision = found.groupBy("rule").agg(((F.count_if("label") + 1) / (F.count("label") + 2)).alias("confidence"))  # one row a rule
    twins = _near(settle(same_work(right), "match-twins"))
    matched = found.select("reference_id", "work_id", "rule").join(twins, "work_id").select("reference_id", F.col("twin_id").alias("work_id"), "rule")
    best = matched.groupBy("reference_id", "work_id").agg(F.min("rule").alias("rule"))
    return best.join(F.broadcast(precision), "rule").select("reference_id", "work_id", "rule", F.round("confidence", 6).alias("confidence"))


def same_work(works: DataFrame) -> DataFrame:
    """(work_id, twin_id): catalogue records of the same work, each with itself.

    Twins have one title, contradict each other in nothing and agree in the
    year, the pages or a name; without a title a record is its only twin.
    """
    a = works.select("work_id", "base", "whole", "year", "pages", "names")
    b = works.select(F.col("work_id").alias("twin_id"), F.col("whole").alias("t_whole"), F.col("year").alias("t_year"), F.col("pages").alias("t_pages"), F.col("names").alias("t_names"))
    year, pages = F.abs(F.col("year") - F.col("t_year")) <= 1, F.col("pages") == F.col("t_pages")
    unnamed, named = (F.size("names") == 0) | (F.size("t_names") == 0), F.arrays_overlap("names", "t_names")
    same = (F.col("whole") == F.col("t_whole")) & (F.col("base") != "") & F.coalesce(year, F.lit(True)) & F.coalesce(pages, F.lit(True)) & (unnamed | named)
    known = F.coalesce(year, F.lit(False)) | F.coalesce(pages, F.lit(False)) | F.coalesce(named, F.lit(False))
    return a.join(b, same & known).select("work_id", "twin_id").union(works.select("work_id", F.col("work_id").alias("twin_id"))).distinct()
