"""One consistent form for text that looks the same (problem 10).

A longest-match transducer over grapheme clusters (a base character with its
combining marks and the invisible characters between them, a Hangul syllable in
parts, half-width kana with its voicing mark) rewrites widths, accents, spaces
and look-alike letters in one pass.  Its mapping is built once from rules and
checked for conflicts: no source has two targets and every target is a fixed
point, so the form of a form is the form itself.  Texts that Unicode calls
canonically equivalent have one form, in every script.

Defined results: null stays null; text without a visible character becomes the
empty string; line ends become ``\\n``, blanks before a line end and around
the text go (they can't be seen).  Superscripts, curly quotes, dashes of
another length and other visibly different marks are left as they are, and so
are joiners between letters of scripts in which they change the shape.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Letters of other scripts whose usual glyph equals a Latin one, source letters above their targets.
LOOK_ALIKES = [
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜ", "ABESIJKMHOPCTYXYGQW"),
    ("аеѕіјорсухԁһԛԝүӏ", "aesijopcyxdhqwyl"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ", "ABEZHIKMNOPTYXCM"),
    ("ονϲϳ", "ovcj"),
    # Armenian, Latin letters of phonetic alphabets
    ("օսցհ", "ough"),
    ("ɑɡ", "ag"),
    # Cherokee, Lisu, Roman numerals
    ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCEHJKLMPRSTVWZ"),
    ("ꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "BCDEFGHIJKLMNOPRSTUVWXYZ"),
    ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"),
]
# Characters that stand for another with the same look.
SAME_LOOK = {"‐": "-", "‑": "-", "µ": "μ", "ʼ": "’", "∕": "/", "⁄": "/", "∶": ":", "﹣": "-"}
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_VISIBLE_FORMAT = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2}
_IGNORED_RANGES = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]


_JOINERS = "\u200c\u200d"  # invisible but for the scripts and signs below, whose shape they change
_JOINED = "\\u0600-\\u08ff\\u0900-\\u0dff\\u1000-\\u109f\\u1780-\\u18af\\u2190-\\u2bff\\ufe0f\\U0001f000-\\U0001faff"
_KANA = "[\uff73\uff76-\uff84\uff8a-\uff8e][\uff9e\uff9f]"  # half-width kana with a voicing mark


def _invisible() -> list[str]:
    out = [chr(c) for c in range(0x20) if c not in (0x09, 0x0A, 0x0D)] + [chr(c) for c in range(0x7F, 0xA0) if c != 0x85]
    out += [chr(c) for c in range(0xA0, 0x10000) if unicodedata.category(chr(c)) == "Cf" and c not in _VISIBLE_FORMAT and chr(c) not in _JOINERS]
    out += [chr(c) for a, b in _IGNORED_RANGES for c in range(a, b + 1)]
    return out


def _assigned() -> range:
    """The code points that can have a canonical decomposition or combine: three planes."""
    return range(0x80, 0x30000)


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every single source character with its target, conflict-checked."""
    table: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"two targets for {source!r}: {table[source]!r} and {target!r}")

    for sources, targets in LOOK_ALIKES:
        for s, t in zip(sources, targets, strict=True):
            add(s, t)
    for s, t in SAME_LOOK.items():
        add(s, t)
    for s in _SPACES:
        add(s, " ")
    for s in dict.fromkeys(_invisible()):
        if s not in table:
            add(s, "")
    for c in range(0xFF01, 0xFFEF):  # full-width and half-width forms
        s = chr(c)
        t = unicodedata.normalize("NFKC", s)
        if t != s and s not in table:
            add(s, "".join(table.get(x, x) for x in t))
    for k in "\uff73\uff76\uff77\uff78\uff79\uff7a\uff7b\uff7c\uff7d\uff7e\uff7f\uff80\uff81\uff82\uff83\uff84\uff8a\uff8b\uff8c\uff8d\uff8e":
        for mark in "\uff9e\uff9f":
            add(k + mark, unicodedata.normalize("NFKC", k + mark))
    for c in range(0xFB00, 0xFB07):  # Latin ligatures
        add(chr(c), unicodedata.normalize("NFKC", chr(c)))
    for c in _assigned():  # precomposed letters on a look-alike base, and singletons
        s = chr(c)
        if 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000:
            continue
        d = unicodedata.normalize("NFD", s)
        if d != s and s not in table:
            t = unicodedata.normalize("NFC", "".join(table.get(x, x) for x in d))
            if t != s:
                add(s, t)
    for s, t in list(table.items()):
        for _ in range(4):
            u = unicodedata.normalize("NFC", "".join(table.get(x, x) for x in t))
            if u == t:
                break
            t = u
        else:
            raise ValueError(f"no fixed point for {s!r}")
        table[s] = t
    return table


def _class(chars: list[str]) -> str:
    """A character class of ranges, for a short pattern."""
    codes = sorted(map(ord, chars))
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}" if i == j else f"\\U{codes[i]:08x}-\\U{codes[j]:08x}")
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def _marks() -> list[str]:
    """What can combine with a character before it: marks of every script, and the vowels and finals of Hangul."""
    out = [chr(c) for c in (*_assigned(), *range(0x30000, 0x30001)) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c))[0] == "M" or unicodedata.combining(chr(c)))]
    out += [chr(c) for a, b in ((0x1161, 0x1175), (0x11A8, 0x11C2)) for c in range(a, b + 1)]
    return [c for c in out if mapping().get(c) != ""]


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


class _Compiled:
    """The patterns of the transducer; for texts within the basic plane shorter ones, which run faster."""

    def __init__(self, top: str) -> None:
        self.table = mapping()
        marks = _class([c for c in _marks() if c <= top])
        self.gone = frozenset(s for s, t in self.table.items() if not t and s <= top)
        gone = _class(list(self.gone))
        self.joiners = re.compile(f"(?<![{_JOINED}])[{_JOINERS}]+|[{_JOINERS}]+(?![{_JOINED}])")
        self.kana = re.compile(_KANA)
        self.sources = re.compile(f"[{_class([s for s in self.table if len(s) == 1 and s <= top])}]+")
        self.mark = re.compile(f"[{marks}]")
        self.tail = re.compile(f"[{marks}](?:[{gone}]*[{marks}])*")  # of a cluster, from its first mark on


@lru_cache(maxsize=2)
def _compiled(top: str = "\uffff") -> _Compiled:
    return _Compiled(top)


def _run(m: re.Match) -> str:
    """The target of a run of sources without marks."""
    run, c = m.group(), _compiled()
    if "\uff9e" in run or "\uff9f" in run:
        run = c.kana.sub(lambda k: c.table[k.group()], run)
    return "".join([c.table.get(x, x) for x in run])


@lru_cache(maxsize=65536)
def _cluster(text: str) -> str:
    """The target of one cluster: base and marks mapped, then composed in canonical order."""
    table = _compiled().table
    flat = unicodedata.normalize("NFD", "".join([table.get(c, c) for c in text]))
    return unicodedata.normalize("NFC", "".join([table.get(c, c) for c in flat]))


def _transduce(text: str) -> str:
    """One pass over the clusters with marks and the runs between them."""
    c = _compiled("\U0010ffff" if _BEYOND.search(text) else "\uffff")
    if "\u200c" in text or "\u200d" in text:
        text = c.joiners.sub("", text)
    out, at = [], 0
    if not text.isascii() and c.mark.search(text):
        for m in c.tail.finditer(text):
            a = m.start()
            while a > at and text[a - 1] in c.gone:
                a -= 1
            if a > at and not text[a - 1].isspace():
                a -= 1
            out += (c.sources.sub(_run, text[at:a]), _cluster(text[a : m.end()]))
            at = m.end()
        text = text[at:]
    return "".join([*out, c.sources.sub(_run, text)])


_LINE_ENDS = re.compile(r"\r\n?|[\u0085\u2028\u2029]")
_BEFORE_END = re.compile(r"[ \t]+(?=\n)")


def canonical(text: str | None) -> str | None:
    """``text`` in the one form that all texts of the same look share."""
    if text is None:
        return None
    if not text.isascii() or not text.isprintable():
        text = _transduce(text)
    if not text.isprintable():
        text = _BEFORE_END.sub("", _LINE_ENDS.sub("\n", text))
    return text.strip()


def normalize_text(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with a column ``out``: the canonical form of ``text``; ``out`` replaces a column of that name."""
    keep = [c for c in df.columns if c != out]
    src = df.select(*[df[f"`{c}`"] for c in keep])
    at = keep.index(text) if text in keep else None
    if at is None:
        raise ValueError(f"no column {text}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + f", `{out}` string"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = pa.array([canonical(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, form], names=[*keep, out])

    return src.mapInArrow(rewrite, schema)
