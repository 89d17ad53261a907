"""Variant spellings of names typed by people (problem 6).

Each spelling is read into its fields: surname, given name, initials, nickname;
an organisation into its words without abbreviations, its place, its acronym.
Persons of one surname are compared where both state a given name that one can
stand for, or one of them only an initial that the other can have; so a common
surname's many given names are never all compared with each other.  Surnames one
slip apart are found by leaving a letter out of each, which misses none.  Organisations come from suffix blocking: suffixes
of each word above a minimum length are indexed, refined by place, beside the
words with one of them damaged.  No key is discarded for being common: equal
fields are one class first, so a block holds different fields only.  Pairs are
compared by the longest-common-subsequence ratio of their fields, and must not
contradict each other in any.

A surname is a slip of one next to it if every spelling of it agrees with a
spelling of the other, and either no two of its own spellings agree (each
person made the slip once), or it is ``RARER`` times rarer, or, where two
letters are exchanged, which makes hardly any other surname, no more frequent.

Nicknames are learned from spellings that state both ("Robert "Bob" ..."), the
common given names from their frequency; both lists hold only entries above a
share of all spellings, which bounds their size.

Defined results: null, blank and "et al." values are no spellings; equal
spellings give no pair; a spelling of a single word links only by its letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.matching import damerau
from docsieve.operators.packed import ORG_TAILS, ORG_WORDS
from docsieve.sources.settle import settle

MIN_SUFFIX = 4
MIN_ERROR = 5  # letters of a surname in which a slip is looked for
RARER = 20  # a surname that one person spells in several ways is taken for a slip of one so many times as frequent
MIN_SHARE = 2e-5  # of all spellings: at most 1 / MIN_SHARE learned names
LCS_RATIO = 0.8

# Abbreviations in names of organisations.
ABBREVIATIONS = {
    "dept": "department", "dep": "department", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "ctr": "centre", "center": "centre", "cent": "centre", "inst": "institute",
    "univ": "university", "u": "university", "fac": "faculty", "sch": "school", "hosp": "hospital", "coll": "college", "acad": "academy", "natl": "national", "intl": "international",
    "stud": "studies", "sci": "sciences", "res": "research", "eng": "engineering", "tech": "technology", "med": "medicine", "for": "of",
}
SMALL = set("of and the for in at on de la le du des der die das und et y e".split())
_ORG = re.compile(rf"(?i)\b(?:{'|'.join(ORG_WORDS)})\b|\b(?:{'|'.join(ORG_TAILS)})\b")
_ET_AL = re.compile(r"(?i)^\W*et\.? al\b\.?\W*$|^等$")


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("æ", "ae").replace("Æ", "Ae"))
    return "".join(c for c in t.lower() if not unicodedata.combining(c))


class Name:
    """The fields of one spelling."""

    __slots__ = ("kind", "surname", "given", "middle", "nick", "words", "place", "acronym")

    def __init__(self, kind: str, surname: str = "", given: str = "", middle: str = "", nick: str = "", words: tuple = (), place: str = "", acronym: str = "") -> None:
        self.kind, self.surname, self.given, self.middle, self.nick, self.words, self.place, self.acronym = kind, surname, given, middle, nick, words, place, acronym

    def packed(self) -> str:
        """The fields as one string; ``unpacked`` reads it."""
        return "\x1f".join([self.kind, self.surname, self.given, self.middle, self.nick, " ".join(self.words), self.place, self.acronym])


def unpacked(fields: str) -> Name:
    kind, surname, given, middle, nick, words, place, acronym = fields.split("\x1f")
    return Name(kind, surname, given, middle, nick, tuple(words.split()), place, acronym)


def _letters(word: str) -> str:
    return "".join(c for c in fold(word) if c.isalpha() or c == "-")


def _is_initial(word: str) -> bool:
    return bool(re.fullmatch(r"(?:[^\W\d_]\.?-?){1,3}", word)) and (len(_letters(word)) == 1 or ("." in word and len(_letters(word).replace("-", "")) <= 3) or (word.isupper() and len(word) <= 2))


def read_org(text: str) -> Name:
    place = ""
    m = re.search(r"\(([^)]+)\)\s*$", text)
    if m:
        place, text = m.group(1), text[: m.start()]
    elif "," in text:
        text, place = text.rsplit(",", 1)
    flat = fold(text.replace("&", " and ").replace("-", ""))
    words = [ABBREVIATIONS.get(w, w) for w in re.findall(r"[a-z0-9]+", flat)]
    core = [w for w in words if w not in SMALL]
    heads = [i for i, w in enumerate(core) if w in ORG_WORDS]
    tails = [i for i, w in enumerate(core) if w in ORG_TAILS]
    where = re.findall(r"[a-z0-9]+", fold(place))
    if not where and heads and heads[0] > 0:  # "Marvik Department of ..."
        where, core = core[: heads[0]], core[heads[0] :]
    elif not where and tails and tails[-1] < len(core) - 1:  # "... Studies Marvik"
        where, core = core[tails[-1] + 1 :], core[: tails[-1] + 1]
    return Name("org", words=tuple(core), place=" ".join(where), acronym="".join(w[0] for w in core))


def read_name(text: str) -> Name | None:
    """The fields of a spelling; None if it is no name."""
    if not text or _ET_AL.match(text) or not re.search(r"[^\W\d_]", text):
        return None
    t = re.sub(r"\s+", " ", text).strip()
    if _ORG.search(t):
        return read_org(t)
    m = re.fullmatch(r"([A-Z]{3,8})[,\s]+\(?([A-ZÀ-Þ][^\W\d_]*[a-zà-ÿ][\w\s-]*)\)?", t)
    if m and len(t.split()) >= 2 and not m.group(2).isupper() and m.group(1)[-1] in "SRTMEPC" and _acronym_like(m.group(1)):
        return Name("acronym", acronym=m.group(1).lower(), place=" ".join(re.findall(r"[a-z0-9]+", fold(m.group(2)))), surname=_letters(m.group(1)), given=_letters(m.group(2)))
    nick = ""
    if n := re.search(r"[\"“'‘(]\s*([^\W\d_][\w-]*)\s*[\"”'’)]", t):
        nick = _letters(n.group(1))
        t = (t[: n.start()] + " " + t[n.end() :]).strip()
    if "," in t:
        last, first = (x.strip() for x in t.split(",", 1))
        given = first.split()
        surname = last
    else:
        words = t.split()
        if len(words) == 1:
            return Name("person", surname=_letters(t), nick=nick)
        caps = [len(_letters(w)) > 2 and w.isupper() for w in words]
        if any(caps) and not all(caps):
            surname = " ".join(w for w, c in zip(words, caps, strict=True) if c)
            given = [w for w, c in zip(words, caps, strict=True) if not c]
        elif _is_initial(words[-1]) and not _is_initial(words[0]):
            surname, given = " ".join(words[:-1]), [words[-1]]
        else:
            surname, given = words[-1], words[:-1]
            while len(given) > 1 and given[-1].lower() in ("van", "von", "de", "der", "den", "di", "da", "la", "le", "del"):
                surname = given.pop() + " " + surname
    initials = [w for w in given if _is_initial(w)]
    full = [w for w in given if not _is_initial(w)]
    if full:
        g, rest = _letters(full[0]), initials + full[1:]
        if given and _is_initial(given[0]):
            rest = full[1:] + initials
        middle = "".join(_letters(w)[:1] for w in rest)
    else:
        parts = [c for w in initials for c in _letters(w).replace("-", "")]
        g, middle = (parts[0] if parts else ""), "".join(parts[1:])
    return Name("person", surname=re.sub("(?<=[aou])e", "", _letters(surname).replace("-", "")), given=g, middle=middle, nick=nick)


def _acronym_like(word: str) -> bool:
    """An acronym of an organisation rather than a surname in capitals: hardly any vowels, or short."""
    return len(word) <= 5 and sum(c in "AEIOU" for c in word) * 2 <= len(word)


@lru_cache(maxsize=200_000)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    return 2.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


class Lists:
    """What is learned from all spellings: how often each given name and surname stands, and which names a nickname is for."""

    def __init__(self, given: dict[str, int], nicknames: dict[str, list[str]]) -> None:
        self.given, self.nicknames = given, nicknames
        self.by_length: dict[int, list[str]] = {}
        top = max(given.values(), default=0)
        for g, n in given.items():
            if n >= max(3, top * 0.1):
                self.by_length.setdefault(len(g), []).append(g)
        self.common = {g for gs in self.by_length.values() for g in gs}
        self.cache: dict[str, frozenset[str]] = {}

    def stands_for(self, given: str) -> frozenset[str]:
        """The common given names a written one may stand for: itself, those it is a nickname of or a misspelling of."""
        hit = self.cache.get(given)
        if hit is None:
            out = {given} if given in self.common or given not in self.nicknames else set()
            out.update(self.nicknames.get(given, ()))
            if given not in self.common and not self.nicknames.get(given) and len(given) >= 3:
                near = [g for k in (-1, 0, 1) for g in self.by_length.get(len(given) + k, ()) if damerau(given, g, 1) <= 1]
                out.update(near)
            hit = self.cache[given] = frozenset(out)
        return hit


def given_agree(a: Name, b: Name, lists: Lists) -> bool:
    if not a.given or not b.given:
        return False
    if len(a.given) == 1 or len(b.given) == 1:
        one, other = (a, b) if len(a.given) == 1 else (b, a)
        if len(other.given) == 1:
            return one.given == other.given
        firsts = {other.given[0], *(g[0] for g in lists.stands_for(other.given))}
        if other.given not in lists.common:
            names = lists.stands_for(other.given) - {other.given}
            firsts = {g[0] for g in names} or firsts
        return one.given in firsts
    return a.given == b.given or bool(lists.stands_for(a.given) & lists.stands_for(b.given)) or b.given == a.nick or a.given == b.nick


def middle_agree(a: Name, b: Name) -> bool:
    return not a.middle or not b.middle or a.middle.startswith(b.middle) or b.middle.startswith(a.middle)


def surname_error(a: str, b: str) -> bool:
    """Whether two surnames differ by one slip of the keyboard."""
    return min(len(a), len(b)) >= MIN_ERROR and a[0:1] + a[-1:] != "" and damerau(a, b, 1) <= 1 and ratio(a, b) >= LCS_RATIO


def same_org(a: Name, b: Name) -> bool:
    if a.kind == "acronym" or b.kind == "acronym":
        return a.acronym == b.acronym and a.place == b.place and len(a.acronym) >= 3 and a.kind != b.kind
    x, y = list(a.words), list(b.words)
    if a.place and b.place and a.place != b.place and damerau(a.place, b.place, 2) > (2 if len(a.place) >= 6 else 1):
        return False
    x, y = x + ([] if a.place and b.place else a.place.split()), y + ([] if a.place and b.place else b.place.split())
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    if not x and not y:
        return True
    if "".join(x) == "".join(y):
        return True
    if ratio(" ".join(a.words), " ".join(b.words)) < 0.9:
        return False
    if len(x) != len(y) or len(x) > 2:
        return len(x) <= 2 and len(y) <= 2 and damerau("".join(x), "".join(y), 1) <= 1
    for w in list(x):
        near = next((v for v in y if damerau(w, v, 2) <= (2 if len(w) >= 8 else 1) and ratio(w, v) >= LCS_RATIO), None)
        if near is None:
            return False
        x.remove(w)
        y.remove(near)
    return True


def agree(a: Name, b: Name, lists: Lists) -> bool:
    """Whether two spellings, with surnames that are equal or one slip apart, agree in all other fields."""
    if a.kind != "person" or b.kind != "person":
        return {a.kind, b.kind} <= {"org", "acronym"} and same_org(a, b)
    return middle_agree(a, b) and given_agree(a, b, lists)


def firsts(n: Name, lists: Lists) -> set[str]:
    """The initials under which a person can agree with another: whenever given_agree holds, two spellings share one."""
    out = {n.given[:1]}
    if len(n.given) > 1:
        out.update(g[:1] for g in lists.stands_for(n.given))
    if n.nick:
        out.add(n.nick[:1])
    return out


def shortened(word: str, most: int = 1) -> set[str]:
    """The word and every form with up to ``most`` letters left out; words within as many slips of each other share one."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def block_keys(n: Name, lists: Lists) -> set[tuple[str, bool]]:
    """The keys of one spelling, none of which is ever discarded, and whether two spellings of that flag aren't compared by it.

    Persons of one surname: a given name has its own keys and, flagged, those
    of its initials; misspelled surnames go by ``near_surnames``.
    """
    if n.kind == "person":
        if not n.surname:
            return set()
        whole = len(n.given) > 1
        keys = {(f"p|{n.surname}|{f}", whole) for f in firsts(n, lists)}
        if whole:
            keys |= {(f"g|{n.surname}|{g}", False) for g in {n.given, *lists.stands_for(n.given), *([n.nick] if n.nick else [])}}
        return keys
    return {(k, False) for k in _org_keys(n)}


def _org_keys(n: Name) -> set[str]:
    keys = set()
    if n.acronym and len(n.acronym) >= 3:
        keys.add(f"a|{n.acronym}|{n.place}")
    if n.kind == "acronym":
        return keys
    significant = {w for w in n.words if len(w) >= MIN_SUFFIX and w not in ORG_WORDS and w not in ORG_TAILS}
    for w in significant:
        for i in range(0, len(w) - MIN_SUFFIX + 1):
            keys.add(f"o|{w[i:]}|{n.place}|{len(n.words)}")
        keys.add(f"w|{w}|{n.acronym}")
    for i, w in enumerate(n.words):  # one damaged word, whatever the place
        rest = " ".join(sorted(n.words[:i] + n.words[i + 1 :]))
        keys.update(f"d|{v}|{rest}" for v in shortened(w, 2 if len(w) >= 8 else 1) if n.words[1:] or len(v) >= MIN_SUFFIX)
    keys.add(f"b|{''.join(sorted(''.join([*n.words, n.place]).replace(' ', '')))}")
    return keys


def _learn(members: DataFrame) -> Lists:
    """Given names and nicknames that stand in enough spellings; at most ``1 / MIN_SHARE`` of each."""
    f = F.split("fields", "\x1f")
    stated = members.select(f[0].alias("kind"), f[2].alias("given"), f[4].alias("nick")).where("kind = 'person' and length(given) > 1")
    counts = settle(stated.groupBy("given", "nick").agg(F.count("*").alias("n")), "name-given")
    least = max(2, int(members.count() * MIN_SHARE))
    given: dict[str, int] = {}
    pairs: dict[str, list[str]] = {}
    rows = [tuple(r) for r in counts.where(f"n >= {least}").collect()]
    for g, k, n in rows:
        if not k:
            given[g] = given.get(g, 0) + n
    top = max(given.values(), default=0)
    for g, k, _ in rows:
        if k and given.get(g, 0) >= top * 0.1 and k != g:
            pairs.setdefault(k, []).append(g)
    return Lists(given, pairs)


def link_names(spellings: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b in code point order: pairs of different spellings of one author.

    ``spellings`` has one column ``name``, one row for each occurrence.
    """
    members, linked = _linked(spellings)
    x, y = (members.select(F.col("fields").alias(f"fields_{k}"), F.col("name").alias(f"_{k}")) for k in "ab")
    both = linked.join(x, "fields_a").join(y, "fields_b").where("fields_a <> fields_b or _a < _b")
    return both.select(F.least("_a", "_b").alias("name_a"), F.greatest("_a", "_b").alias("name_b")).distinct()


def name_classes(spellings: DataFrame) -> DataFrame:
    """(name, class_id, links): every spelling, the class of spellings with equal fields, and with how many other spellings it is linked.

    Linked classes stand in for their members, so no pair of members is formed.
    """
    members, linked = _linked(spellings)
    size = members.groupBy("fields").agg(F.count("*").alias("_n"))
    both = linked.where("fields_a <> fields_b").select("fields_a", "fields_b").union(linked.where("fields_a <> fields_b").select("fields_b", "fields_a")).distinct()
    other = both.join(size.withColumnRenamed("fields", "fields_b"), "fields_b").groupBy(F.col("fields_a").alias("fields")).agg(F.sum("_n").alias("_other"))
    own = linked.where("fields_a = fields_b").select(F.col("fields_a").alias("fields"), F.lit(1).alias("_own")).distinct()
    each = size.join(other, "fields", "left").join(own, "fields", "left").withColumn("links", F.coalesce("_other", F.lit(0)) + F.when(F.col("_own").isNotNull(), F.col("_n") - 1).otherwise(0))
    return members.join(each, "fields").select("name", F.sha2("fields", 256).alias("class_id"), "links")


def _linked(spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spellings with their fields, and the pairs of fields that are linked."""
    spark = spellings.sparkSession
    names = spellings.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.count("*").alias("rows"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [n and n.packed() for n in map(read_name, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fields, pa.string())], names=["name", "rows", "fields"])

    # spellings of equal fields are one class until the pairs are formed
    members = settle(names.mapInArrow(read, "name string, rows bigint, fields string").where("fields is not null"), "name-fields")
    lists = _learn(members)
    sent = spark.sparkContext.broadcast((lists.given, lists.nicknames))  # at most 2 / MIN_SHARE names
    kept: dict[str, Lists] = {}

    def learned() -> Lists:
        if "l" not in kept:
            kept["l"] = Lists(*sent.value)
        return kept["l"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, apart = [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                for k, flag in block_keys(unpacked(t), learned()):
                    at.append(i), keys.append(k), apart.append(flag)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(apart, pa.bool_())], names=["fields", "key", "apart"])

    def initials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, surname, first = [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                n = unpacked(t)
                if n.kind == "person" and n.given and len(n.surname) >= MIN_ERROR:
                    for f in firsts(n, learned()):
                        at.append(i), surname.append(n.surname), first.append(f)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(surname, pa.string()), pa.array(first, pa.string())], names=["fields", "surname", "first"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = lru_cache(maxsize=50_000)(unpacked)
        for batch in batches:
            ok = [agree(fields(x), fields(y), learned()) for x, y in zip(batch.column("fields_a").to_pylist(), batch.column("fields_b").to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    classes = members.groupBy("fields").agg((F.count("*") == 1).alias("single"), F.sum("rows").alias("rows"))
    keyed = settle(classes.select("fields").mapInArrow(index, "fields string, key string, apart boolean"), "name-keys")
    # one side without the spellings that aren't compared with each other by their key, so a hot key never meets itself whole
    a, b = keyed.where("not apart").alias("a"), keyed.alias("b")
    pairs = a.join(b, F.expr("a.key = b.key and (b.apart or a.fields <= b.fields)")).select(F.least("a.fields", "b.fields").alias("fields_a"), F.greatest("a.fields", "b.fields").alias("fields_b")).distinct()
    same = settle(pairs.mapInArrow(compare, pairs.schema), "name-same")

    persons = settle(classes.select("fields").mapInArrow(initials, "fields string, surname string, first string"), "name-initials")
    near = near_surnames(persons.select("surname").distinct())
    left, right = (persons.select(F.col("fields").alias(f"fields_{x}"), F.col("surname").alias(f"surname_{x}"), "first") for x in "ab")
    slips = near.join(left, "surname_a").join(right, ["surname_b", "first"]).select("surname_a", "surname_b", "fields_a", "fields_b", "exchanged").distinct()
    slips = settle(slips.mapInArrow(compare, slips.schema), "name-slips")
    # of each surname: its classes, its rows, and whether two of its spellings agree
    mine = persons.select("fields", "surname").distinct()
    several = same.where("fields_a <> fields_b").select(F.col("fields_a").alias("fields")).unionAll(classes.where("not single").select("fields")).distinct().withColumn("several", F.lit(True))
    facts = settle(mine.join(classes, "fields").join(several, "fields", "left").groupBy("surname").agg(F.count("*").alias("classes"), F.sum("rows").alias("rows"), F.max(F.coalesce("several", F.lit(False))).alias("several")), "surname-facts")
    linked = same
    for slip, other in (("a", "b"), ("b", "a")):
        s = facts.select(F.col("surname").alias(f"surname_{slip}"), F.col("classes").alias("c"), F.col("rows").alias("r"), F.col("several").alias("v"))
        o = facts.select(F.col("surname").alias(f"surname_{other}"), F.col("rows").alias("t"))
        pair = slips.groupBy("surname_a", "surname_b", "exchanged").agg(F.count_distinct(f"fields_{slip}").alias("agreeing"))
        pair = pair.join(s, f"surname_{slip}").join(o, f"surname_{other}").where(f"agreeing = c and (not v or r * if(exchanged, 1, {RARER}) <= t)")
        linked = linked.unionAll(slips.join(pair.select("surname_a", "surname_b"), ["surname_a", "surname_b"], "left_semi").select("fields_a", "fields_b"))
    return members, linked


def near_surnames(surnames: DataFrame) -> DataFrame:
    """(surname_a, surname_b, exchanged): different surnames one slip apart, every pair of them, and whether the slip exchanged two letters.

    Two such surnames are equal with at most one letter left out of each, so
    these forms join.  A form is shared by no more surnames than there are
    places and letters to put in.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                for v in shortened(t):
                    at.append(i), out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["surname", "form"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            exchanged = pa.array([sorted(x) == sorted(y) for x, y in two], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), exchanged], names=["surname_a", "surname_b", "exchanged"]).filter(pa.array([surname_error(x, y) for x, y in two], pa.bool_()))

    keyed = settle(surnames.where(F.length("surname") >= MIN_ERROR).mapInArrow(forms, "surname string, form string"), "surname-forms")
    a, b = keyed.select(F.col("surname").alias("surname_a"), "form"), keyed.select(F.col("surname").alias("surname_b"), "form")
    pairs = a.join(b, "form").where("surname_a < surname_b").select("surname_a", "surname_b").distinct()
    return settle(pairs.mapInArrow(compare, "surname_a string, surname_b string, exchanged boolean"), "near-surnames")
