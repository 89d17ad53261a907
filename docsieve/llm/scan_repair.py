"""Repair of text from scanned pages (problem 3).

Works one document at a time, with a vocabulary counted over the whole corpus:

* page furniture: running headers (forms of the title, authors "et al.",
  with or without a page number, misread or not) and page numbers alone are
  found as lines, or inside a paragraph whose line ends became spaces;
* words hyphenated across lines are joined; the vocabulary decides whether the
  hyphen belongs to the word;
* misread characters: a Levenshtein automaton of one error (substitution,
  insertion, deletion, and the merges and splits that scanners make), or of two
  known misreadings in a longer word, is intersected with a trie of the
  vocabulary, which retrieves every candidate; frequency, the kind of
  misreading, the document's own words and, where candidates are close, the
  words that stand beside them elsewhere in the document rank them;
* the rest is reflowed into paragraphs.

The vocabulary goes to the executors.  It holds the words with at least
``MIN_SHARE`` of all word occurrences, hence at most ``1 / MIN_SHARE`` words,
whatever the corpus.

Defined results: null and empty paragraphs are left as they are; text without
signs of scanning is not changed; texts of any length are repaired whole; rows
that repeat a document give one result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.sources.settle import settle

MIN_SHARE = 1e-6
MIN_COUNT = 3
TWICE = 8  # letters of a word in which two misreadings are looked for
MIN_HEADER = 16  # letters of a header that is known without the title
ESTABLISHED = 4e-5  # of all occurrences: share of a word that stands on its own beside a hyphen
RARER = 40  # a word of the vocabulary is taken for a misreading if a look-alike is so many times as frequent

# What a scanner reads (left) for what stands on the page (right).
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("m", "in"), ("in", "m"), ("m", "ni"), ("h", "li"), ("li", "h"),
    ("h", "ti"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("b", "h"), ("h", "b"), ("c", "e"), ("e", "c"), ("c", "o"), ("o", "c"), ("f", "t"),
    ("t", "f"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("j", "i"), ("i", "j"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"),
    ("0", "o"), ("5", "s"), ("$", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("q", "g"), ("g", "q"), ("2", "z"), ("7", "t"), ("4", "a"), ("@", "a"), ("3", "e"),
    ("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("e", "o"), ("o", "e"), ("a", "e"), ("e", "a"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("nn", "m"), ("rm", "nn"), ("iii", "m"), ("s", "a"), ("k", "h"), ("l<", "k"),
]
_BY_SEEN: dict[str, list[str]] = {}
for _seen, _true in CONFUSIONS:
    _BY_SEEN.setdefault(_seen, []).append(_true)
_CONFUSABLE = set(CONFUSIONS)
HYPHENS = "-‐­¬‑"
CONJUNCTIONS = set("and or und oder bzw et ou y o e nor to bis".split())
_WORD = re.compile(r"[^\W\d_]+(?:[-‑'’][^\W\d_]+)*")
_ROMAN = r"[ivxlc]{1,8}"
_PAGE_NO = re.compile(rf"(?:[-–—]\s*\d{{1,4}}\s*[-–—]|(?:p|pp|S|pag|pág|page|Page|PAGE|Seite|página|Página)\.?\s*\d{{1,4}}|\d{{1,4}}\s*/\s*\d{{1,4}}|\d{{1,4}}|{_ROMAN}|[\[(]\d{{1,4}}[\])])")
_EDGE = re.compile(r"^[^\w@$!|]+|[^\w@$]+$")
_ET_AL = re.compile(r"(?:\d{1,4}\s+)?(?:[^\W\d_][\w.'’-]*\s+){1,3}et a[l1I|!]\.?(?:\s+\d{1,4})?")

_VOLUME = re.compile(r"(?:\d{1,4}\s+)?[^\W\d_].*,\s*(?:[Vv][o0][l1I|!]|[Bb]d|[Tt])\.?\s*\d+\s*(?:\(\d+\))?(?:\s+\d{1,4})?")
_VOLUME_INLINE = re.compile(r"(?<=\s)[A-ZÀ-Þ][\w'’.-]*(?:\s(?:[A-ZÀ-Þ][\w'’.-]*|of|in|on|the|and|de|der|für|for|del|et|&))*,\s(?:V[o0][l1I|!]|Bd)\.\s\d+(?:\(\d+\))?(?=\s)")


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): occurrences of each word, lower-cased, over all rows; counted per batch first, then combined."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    total.update(_WORD.findall(t.lower()))
            if len(total) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
                total = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return texts.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words with their counts, and a trie over them."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.most, self.total = max(counts.values(), default=0), sum(counts.values())
        self.root: dict = {}
        self.cache: dict[str, list[tuple[str, float]]] = {}
        for w in counts:
            if len(w) >= 3:
                node = self.root
                for ch in w:
                    node = node.setdefault(ch, {})
                node[""] = w

    def established(self, word: str) -> bool:
        """Whether a word has its share of all occurrences, however large the corpus."""
        return self.counts.get(word.lower(), 0) >= max(1.0, ESTABLISHED * self.total)

    @staticmethod
    def _walk(node: dict, rest: str) -> dict | None:
        for ch in rest:
            node = node.get(ch)
            if node is None:
                return None
        return node

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """All words within one error, with the cost of the cheapest: 0.0 a known misreading, 1.0 any other edit."""
        if word in self.cache:
            return self.cache[word]
        found: dict[str, float] = {}

        def take(node: dict | None, rest: str, cost: float) -> None:
            end = self._walk(node, rest) if node is not None else None
            if end is not None and "" in end:
                w = end[""]
                if w != word and cost < found.get(w, 9.0):
                    found[w] = cost

        node, n = self.root, len(word)
        for i in range(n + 1):
            for size in (1, 2, 3):
                for true in _BY_SEEN.get(word[i : i + size], ()) if i + size <= n else ():
                    take(self._walk(node, true), word[i + size :], 0.0)
            if i < n:
                take(node, word[i + 1 :], 1.0)
            for ch, child in node.items():
                if ch:
                    take(child, word[i:], 1.0)
                    if i < n and ch != word[i]:
                        take(child, word[i + 1 :], 1.0)
            if i < n:
                node = node.get(word[i])
                if node is None:
                    break
        if len(self.cache) < 200_000:
            self.cache[word] = list(found.items())
        return list(found.items())

    def candidates_twice(self, word: str) -> list[tuple[str, float]]:
        """All words that two known misreadings in different places lead to."""
        key = "2" + word
        if key in self.cache:
            return self.cache[key]
        found: dict[str, float] = {}

        def go(node: dict | None, at: int, left: int) -> None:
            """Walk the rest of the word from ``at`` with ``left`` misreadings to come."""
            while node is not None:
                if left:
                    for size in (1, 2, 3):
                        if at + size <= len(word):
                            for true in _BY_SEEN.get(word[at : at + size], ()):
                                go(self._walk(node, true), at + size, left - 1)
                if at == len(word):
                    if not left and "" in node and node[""] != word:
                        found[node[""]] = 0.0
                    return
                node = node.get(word[at])
                at += 1

        go(self.root, 0, 2)
        if len(self.cache) < 200_000:
            self.cache[key] = list(found.items())
        return list(found.items())

    def correct(self, word: str, local: Counter | None = None, beside: Callable[[str, str], int] | None = None) -> str | None:
        """The word that ``word`` is a misreading of, or None; ``beside(word, candidate)``: how often the candidate stands next to the word's neighbours."""
        n = self.counts.get(word, 0)
        odd = not word.replace("-", "").replace("’", "").replace("'", "").isalpha() or any(c in "ﬀﬁﬂﬃﬄ" for c in word)
        if n * RARER > self.most:
            return None  # no look-alike can be so many times as frequent
        ranked = self._ranked(word, self.candidates(word), n, odd, local)
        if not ranked and not n and len(word) >= TWICE:
            ranked = self._ranked(word, self.candidates_twice(word), n, odd, local)
        if not ranked:
            return None
        best = max(ranked)
        if beside:
            close = [(score, w) for score, w in ranked if score >= best[0] - 3.0]
            if len(close) > 1:
                best = max((score + 2.0 * min(beside(word, w), 2), w) for score, w in close)
        return best[1]

    def _ranked(self, word: str, candidates: list[tuple[str, float]], n: int, odd: bool, local: Counter | None) -> list[tuple[float, str]]:
        out = []
        for w, cost in candidates:
            c = self.counts[w]
            if n and c < RARER * n:
                continue
            if cost and (len(word) < 6 or odd is False and n):
                continue
            if len(w) < 3 or (len(w) < 4 and not odd):
                continue
            out.append((1.0 + _log2(c) - 6.0 * cost + (2.0 if local and local.get(w) else 0.0), w))
        return out


def _log2(n: int) -> float:
    return float(n.bit_length())


def _fold(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


@lru_cache(maxsize=4096)
def _cuts(text: str, n: int) -> list[str]:
    """``text`` in ``n`` pieces."""
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


def _distance(a: str, b: str, limit: int) -> int:
    """Levenshtein distance, cut off above ``limit``.  Of ``limit`` + 1 pieces of one text the other holds at least one unchanged."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit or len(b) > limit and not any(p in a for p in _cuts(b, limit + 1)):
        return limit + 1
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        prev, row[0] = row[0], i
        low = i
        for j, cb in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (ca != cb))
            low = min(low, row[j])
        if low > limit:
            return limit + 1
    return row[-1]


_CAPITALS = re.compile(r"[^\W\d_a-z][^\s.;]*")


def _capital_runs(text: str) -> list[str]:
    """Runs of at least three words in capitals (one misread digit a word) inside other text."""
    runs, run = [], []
    for token in [*text.split(), ""]:
        word = token.strip("?!:,")
        if _CAPITALS.fullmatch(word) and word == word.upper() and sum(c.isdigit() for c in word) <= 1:
            run.append(token)
            continue
        if len(run) >= 3 and len(_fold("".join(run))) >= MIN_HEADER and sum(len(w) >= 4 for w in run) >= 2:
            runs.append(" ".join(run))
        run = []
    return runs


def headers_in(texts: list[str | None]) -> list[str]:
    """Running headers that a document shows without its title: lines and runs in capitals, lines that
    recur where they interrupt a sentence or stand beside a page number, lines inside a broken word."""
    sure, maybe = [], []
    for t in texts:
        if not t or t == t.upper():
            continue
        lines = [x for x in map(str.strip, t.split("\n")) if x]
        for i, line in enumerate(lines):
            bare = re.sub(r"^\d{1,4}\s+|\s+\d{1,4}$", "", line)
            if len(lines) == 1 or bare == bare.upper():
                sure += _capital_runs(line)
                continue
            if len(bare.split()) < 3 or len(_fold(bare)) < MIN_HEADER or not bare[0].isupper() or re.search(rf"[.;]\s|[{HYPHENS}.,;:]$", bare):
                continue
            before = next((x for x in reversed(lines[:i]) if not _PAGE_NO.fullmatch(x)), ".")
            after = next((x for x in lines[i + 1 :] if not _PAGE_NO.fullmatch(x)), "")
            inside = before[-1] not in ".!?:" and after[:1].islower()
            if inside and before[-1] in HYPHENS:
                sure.append(bare)
            elif inside or any(_PAGE_NO.fullmatch(x) for x in lines[max(0, i - 1) : i + 2]):
                maybe.append(bare)
    out: list[str] = []
    for line, alone in [(x, False) for x in sure] + [(x, True) for x in maybe]:
        f = _fold(line)
        limit = max(1, len(f) // 8)
        if any(_distance(f, _fold(x), limit) <= limit for x in out):
            continue
        if not alone or sum(_distance(f, _fold(x), limit) <= limit for x in maybe) >= 2:
            out.append(line)
    return out


class Furniture:
    """The running headers of one document; without a title, those that its ``texts`` show."""

    def __init__(self, title: str | None, authors: list[str] | None, texts: list[str | None] | None = None) -> None:
        self.forms: list[str] = []
        if title and len(_fold(title)) >= 8:
            parts = {title, re.split(r"[:?.]\s", title)[0], title.split(":")[0]}
            self.forms = sorted({f for p in parts if len(f := _fold(p)) >= 8}, key=len, reverse=True)
        elif texts:
            found = headers_in(texts)
            self.forms = sorted({_fold(h) for h in found}, key=len, reverse=True)
            title = " ".join(found)
        self.names = {_fold(w) for a in authors or [] if a for w in re.findall(r"[^\W\d_][\w'’-]+", a)}
        self.title_words = re.findall(r"[^\W_]+", title or "")
        long = {w for w in self.title_words if len(w) >= 6}
        self.cues = sorted(long | {w.upper() for w in long})

    def is_header(self, line: str) -> bool:
        s = line.strip()
        if _ET_AL.fullmatch(s) or _VOLUME.fullmatch(s):
            return True
        bare = re.sub(r"^\s*\d{1,4}\s+|\s+\d{1,4}\s*$", "", s)
        f = _fold(bare)
        if len(f) < 8:
            return False
        for form in self.forms:
            limit = max(1, len(form) // 8)
            if abs(len(f) - len(form)) <= limit and _distance(f, form, limit) <= limit:
                return True
            if len(f) >= 16 and len(f) < len(form) and len(bare.split()) >= 3 and _distance(f, form[: len(f)], len(f) // 10) <= len(f) // 10:
                return True
        return False

    def inline(self, text: str) -> list[tuple[int, int]]:
        """Spans of headers inside a text whose line ends became spaces."""
        spans = []
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        folded = [_fold(text[a:b]) for a, b in tokens]
        for form in self.forms:
            n = len(re.findall(r"\S+", next((p for p in [" ".join(self.title_words)] if p), "")))
            for i in range(len(tokens)):
                if not folded[i] or folded[i][0] != form[0] and folded[i][:1] not in "0158|!":
                    continue
                if _distance(folded[i], form[: len(folded[i])], max(1, len(folded[i]) // 5)) > max(1, len(folded[i]) // 5):
                    continue
                joined = ""
                for j in range(i, min(len(tokens), i + n + 6)):
                    joined += folded[j]
                    limit = max(1, len(form) // 8)
                    if len(joined) > len(form) + limit:
                        break
                    if abs(len(joined) - len(form)) <= 2 and _distance(joined, form, limit) <= limit:
                        a, b = tokens[i][0], tokens[j][1]
                        if not text[a:b].isupper():  # a page number follows a title in its own case, or leads it
                            if j + 1 < len(tokens) and folded[j + 1].isdigit() and tokens[j + 1][1] - tokens[j + 1][0] <= 4:
                                b = tokens[j + 1][1]
                            elif i and folded[i - 1].isdigit() and tokens[i - 1][1] - tokens[i - 1][0] <= 4:
                                a = tokens[i - 1][0]
                        if not any(x < b and a < y for x, y in spans):
                            spans.append((a, b))
                        break
        for m in re.finditer(r"(?:(?<=\s)|^)(?:\d{1,4} )?([^\W\d_][\w'’-]+) et a[l1I|!]\.(?: \d{1,4}(?=\s))?(?=\s|$)", text):
            if m.group(1)[0].isupper() and not any(x < m.end() and m.start() < y for x, y in spans):
                spans.append(m.span())
        for m in _VOLUME_INLINE.finditer(text):
            if not any(x < m.end() and m.start() < y for x, y in spans):
                spans.append(m.span())
        return sorted(spans)


_INLINE_NO = re.compile(rf"(?<=\s)(?:[-–—] \d{{1,4}} [-–—]|(?:p\.|Page) \d{{1,4}}|\d{{1,4}} / \d{{1,4}})(?=\s|$)")


class Repaired:
    """One paragraph after repair: its text and its defects (kind, item)."""

    __slots__ = ("text", "defects")

    def __init__(self, text: str, defects: list[tuple[str, str]]) -> None:
        self.text, self.defects = text, defects


def scanned(texts: list[str | None]) -> bool:
    """Whether a document shows signs of scanning: line ends inside paragraphs, or broken words."""
    return any(t and ("\n" in t or _BROKEN.search(t)) for t in texts)


_BROKEN = re.compile(r"[a-zà-ÿ](?:[‐­¬]\s|-\s(?!(?:and|or|und|oder|et|ou|y|o|e|to|bis|bzw)\b))[a-zà-ÿ]")
_BREAK = re.compile(rf"([^\W\d_][\w’'-]*)([{HYPHENS}])\s*[\n ]\s*([^\W\d_][\w’'-]*)")


def _own_hyphen(left: str, right: str, mark: str, vocabulary: Vocabulary) -> str | None:
    """The word that a break leaves: joined, or with its own hyphen; None if it isn't one word."""
    joined, kept = left + right, f"{left}-{right}"
    nj, nk = vocabulary.counts.get(joined.lower(), 0), vocabulary.counts.get(kept.lower(), 0)
    if nk > nj:
        return kept
    if nj:
        return joined
    if right.lower() in CONJUNCTIONS:
        return None
    if mark == "-" and "-" not in left and vocabulary.established(left) and vocabulary.established(right) and len(left) > 3 and len(right) > 3:
        fixed = vocabulary.correct(joined.lower())
        if fixed is None:
            return kept
    return joined


class Neighbours:
    """Which words stand beside each other in a document; counted when first asked for."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts, self.pairs, self.near = texts, None, {}

    def beside(self, word: str, candidate: str) -> int:
        """How often ``candidate`` stands elsewhere in the document before or after a neighbour of ``word``."""
        if self.pairs is None:
            self.pairs = Counter()
            for t in self.texts:
                tokens = [_EDGE.sub("", x) for x in (t or "").lower().split()]
                for pair in zip(tokens, tokens[1:], strict=False):
                    self.pairs[pair] += 1
                    self.near.setdefault(pair[0], set()).add((1, pair[1]))
                    self.near.setdefault(pair[1], set()).add((0, pair[0]))
        return sum(self.pairs[(candidate, x) if after else (x, candidate)] for after, x in self.near.get(word, ()))


def repair(text: str, furniture: Furniture, vocabulary: Vocabulary, local: Counter | None = None, pages: set[int] | None = None, neighbours: Neighbours | None = None) -> Repaired:
    """Repair one paragraph."""
    defects: list[tuple[str, str]] = []
    if "\n" in text:
        body = []
        for line in text.split("\n"):
            s = line.strip()
            if s and furniture.is_header(s):
                defects.append(("header", s))
            elif s and _PAGE_NO.fullmatch(s) and not (body and s.endswith(".")):
                defects.append(("pageno", s))
            else:
                body.append(line)
        text = "\n".join(body)
    else:
        for m in reversed(list(_INLINE_NO.finditer(text))):
            before = text[: m.start()].rstrip()[-12:].lower()
            if re.search(r"(?:see|siehe|voir|ver|cf\.|vgl\.)$", before):
                continue
            defects.append(("pageno", m.group()))
            text = text[: m.start()].rstrip() + " " + text[m.end() :].lstrip()
        for a, b in reversed(furniture.inline(text)):
            defects.append(("header", text[a:b]))
            text = text[:a].rstrip() + " " + text[b:].lstrip()
        if pages:
            for m in reversed(list(re.finditer(rf"(?<=[a-zà-ÿ,{HYPHENS}] )(\d{{1,4}}|{_ROMAN})(?= [a-zà-ÿ])", text))):
                word = m.group(1)
                before = text[: m.start()].rstrip()
                broken = before.endswith(tuple(HYPHENS))
                if (word.isdigit() and int(word) in pages and broken) or (not word.isdigit() and len(word) > 2 and word not in vocabulary.counts and re.fullmatch(_ROMAN, word)):
                    defects.append(("pageno", word))
                    text = before + " " + text[m.end() :].lstrip()
    parts, at = [], 0
    joins: list[str] = []
    while m := _BREAK.search(text, at):
        left, mark, right = m.groups()
        word = _own_hyphen(left, right, mark, vocabulary)
        if word is None or ("\n" not in m.group() and mark == "-" and not (vocabulary.counts.get(word.lower()) or vocabulary.correct(word.lower()))):
            parts.append(text[at : m.end(2)])
            at = m.end(2)
            continue
        parts.append(text[at : m.start()])
        joins.append(word)
        text = word + text[m.end() :]
        at = 0
        # the joined word may itself be broken once more
        again = _BREAK.match(text)
        if not again:
            parts.append(word)
            at = len(word)
    text = "".join(parts) + text[at:]
    fixed: dict[str, str] = {}
    for token in set(text.split()):
        word = _EDGE.sub("", token)
        if word in fixed or len(word) < 3 or not word[-1:].isalpha() and not word[-1:].isdigit() and word[-1:] not in "@$!|":
            continue
        if word != word.lower() or not re.search(r"[^\W\d_]{2}", word) or sum(c.isdigit() for c in word) > 1 or "/" in word or "." in word:
            continue
        right = vocabulary.correct(word, local, neighbours.beside if neighbours else None)
        if right and right != word:
            fixed[word] = right
    for w in joins:
        item = _EDGE.sub("", w)
        defects.append(("hyphen", fixed.get(item, item)))
    if fixed:
        pattern = re.compile(r"(?<![\w@$])(?:" + "|".join(map(re.escape, sorted(fixed, key=len, reverse=True))) + r")(?![\w@$])")
        joined = {_EDGE.sub("", w) for w in joins}
        seen = set()
        for m in pattern.finditer(text):
            seen.add(m.group())
        for w in seen:
            if w not in joined:
                defects.append(("glyph", fixed[w]))
        text = pattern.sub(lambda m: fixed[m.group()], text)
    return Repaired(re.sub(r"\s+", " ", text).strip(), defects)


def vocabulary_of(parsed: DataFrame) -> Vocabulary:
    """The words of all sections and abstracts that are frequent enough; at most ``1 / MIN_SHARE`` of them."""
    texts = parsed.select(F.explode(F.expr("concat(array(abstract), flatten(transform(coalesce(sections, array()), s -> transform(coalesce(s.paragraphs, array()), p -> p.text))))")).alias("t")).where("t is not null")
    counts = settle(word_counts(texts, "t").where(f"n >= {MIN_COUNT}"), "word-counts")
    rows = counts.groupBy().agg(F.sum("n")).collect()[0][0] or 0
    least = max(MIN_COUNT, int(rows * MIN_SHARE))
    return Vocabulary({r[0]: r[1] for r in counts.where(f"n >= {least}").toLocalIterator()})


def _documents(parsed: DataFrame) -> DataFrame:
    texts = F.expr("transform(coalesce(sections, array()), s -> struct(s.ordinal as ordinal, transform(coalesce(s.paragraphs, array()), p -> struct(p.text as text, p.page as page)) as paragraphs))")
    return parsed.select("id", "title", "authors", "abstract", texts.alias("sections"))


def repair_documents(parsed: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(document_id, section_no, paragraph_no, text, defects): every paragraph of documents with signs of scanning, repaired.

    Section and paragraph 0 are the abstract.
    """
    spark = parsed.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary.counts)  # at most 1 / MIN_SHARE words
    schema = "document_id string, section_no int, paragraph_no int, text string, defects array<struct<kind:string,item:string>>"
    kept: dict[str, Vocabulary] = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept.setdefault("v", None) or Vocabulary(sent.value)
        kept["v"] = words
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                places = [(0, 0, row["abstract"], None)] + [(s["ordinal"], i, p["text"] if p else None, p["page"] if p else None) for s in row["sections"] if s for i, p in enumerate(s["paragraphs"], 1)]
                if not scanned([t for _, _, t, _ in places]):
                    continue
                furniture = Furniture(row["title"], row["authors"], [t for _, _, t, _ in places])
                local = Counter(w for _, _, t, _ in places if t for w in _WORD.findall(t.lower()))
                neighbours = Neighbours([t for _, _, t, _ in places])
                numbers = {p + d for *_, p in places if p is not None for d in (-1, 0, 1, 2)}
                for s, n, t, page in places:
                    if t and t.strip():
                        r = repair(t, furniture, words, local, numbers, neighbours)
                        out.append((row["id"], s, n, r.text, [{"kind": k, "item": i} for k, i in r.defects]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.string()), pa.array([o[4] for o in out], pa.list_(pa.struct([("kind", pa.string()), ("item", pa.string())])))],
                names=["document_id", "section_no", "paragraph_no", "text", "defects"],
            )

    return _documents(parsed).mapInArrow(work, schema)


def scan_defects(parsed: DataFrame) -> DataFrame:
    """(document_id, section_no, paragraph_no, kind, item): one row for each defect."""
    fixed = repair_documents(parsed, vocabulary_of(parsed))
    d = fixed.select("document_id", "section_no", "paragraph_no", F.explode("defects").alias("d"))
    return d.select("document_id", "section_no", "paragraph_no", F.col("d.kind").alias("kind"), F.col("d.item").alias("item")).distinct()
