"""Language of documents and of segments inside them (problem 5).

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces
(forward algorithm), so no single segmentation has to be right; characters
outside the vocabulary fall back to its byte pieces.  Piece probabilities are
fitted by expectation-maximisation over the words of a bounded sample of
labelled documents; wrong labels are removed by relabelling the sample with
the fitted model and fitting again.

Sentences are scored by the sum over their words.  A document's language is the
most probable one over all its sections; a paragraph is foreign in a language
if at least one full sentence is.  Confidence is the posterior probability
under equal priors, tempered by ``TEMPER`` because words aren't independent.

Text in none of ``LANGUAGES`` is ``other``: its words score ``UNLIKE`` standard
deviations a word below what words of their length score in the best language,
and the whole text ``UNLIKE_TEXT`` of its own.  What words of a length score is
learned from the sample too.  ``other`` is no case of a wrong label.

Defined results: null, empty or wordless texts have no language (null, 0.0);
labels are read in any notation (ISO codes, regional forms, names); an unknown
label counts as missing; rows that repeat a document give one result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.scan_repair import Furniture

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LANGUAGES = ("en", "de", "fr", "es", "pt", "zh")
OTHER = "other"
SAMPLE_DOCUMENTS = 1500  # labelled documents the model is fitted on, the smallest by hash
UNLIKE = 2.75  # standard deviations a word below the expected score at which a text is in none of LANGUAGES
UNLIKE_TEXT = 8.0  # the same for the whole text, so a few odd words don't count
MIN_MARGIN = 6.0  # natural log by which a sentence must favour another language
MIN_LETTERS = 25  # letters in a full sentence; ideographs count as MIN_LETTERS / 8
TEMPER = 0.2

# Names and three-letter codes of the languages.
NAMES = {
    "en": "en eng english englisch anglais inglés inglês 英语 英文",
    "de": "de deu ger german deutsch allemand alemán alemão 德语 德文",
    "fr": "fr fra fre french französisch français francés francês 法语 法文",
    "es": "es spa esp spanish spanisch espagnol español espanhol castellano 西班牙语",
    "pt": "pt por portuguese portugiesisch portugais portugués português 葡萄牙语",
    "zh": "zh zho chi cmn chinese chinesisch chinois chino chinês 中文 汉语 zh-hans zh-hant",
}
_NAME = {n: code for code, names in NAMES.items() for n in names.split()}


def read_label(label: str | None) -> str | None:
    """The language a label names, in any notation; None if it names none of LANGUAGES."""
    if not label or not label.strip():
        return None
    s = label.strip().lower().replace("_", "-")
    return _NAME.get(s) or _NAME.get(re.split(r"[-\s(]", s)[0])


_CJK = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(f"[{_CJK}]|(?:(?![{_CJK}])[^\\W\\d_])+")
_FAST = re.compile(r"[^\W\d_]+")
_HAS_CJK = re.compile(f"[{_CJK}]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­¬]\s*[\n ]\s*(?=[a-zà-ÿ])")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]»”]*\s+(?=[^a-zà-ÿ\s])|(?<=[。！？])")


def split_words(text: str) -> list[str]:
    """The words that are scored: letters only, lower-cased, without the capitals of codes; each ideograph is one."""
    found = (_WORD if _HAS_CJK.search(text) else _FAST).findall(text)
    return [w.lower() for w in found if len(w) > 3 or not w.isupper() or not w.isascii()]


class Pieces:
    """The fixed vocabulary: piece to number, byte pieces for the rest."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.number: dict[str, int] = {}
        self.byte = np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.number[sp.id_to_piece(i)] = i
        self.size = sp.get_piece_size()
        self.longest = 16

    def arcs(self, word: str) -> list[tuple[int, int, list[int]]]:
        """(start, end, pieces) of every piece that fits the word; a character that none covers gets its bytes."""
        s = word if _HAS_CJK.match(word) else "▁" + word
        out, covered = [], [False] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                p = self.number.get(s[i:j])
                if p is not None:
                    out.append((i, j, [p]))
                    if j == i + 1:
                        covered[i] = True
        for i, ok in enumerate(covered):
            if not ok:
                out.append((i, i + 1, [int(self.byte[b]) for b in s[i].encode("utf-8", "replace")]))
        out.sort(key=lambda a: a[1])
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


MAX_WORD = 60  # longer runs of letters are scored in parts


def forward(word: str, vocab: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log-probability of the word in each language: the sum over all segmentations."""
    if len(word) > MAX_WORD:
        return sum((forward(word[i : i + MAX_WORD], vocab, prob) for i in range(0, len(word), MAX_WORD)), np.zeros(prob.shape[1]))
    n = len(word) + (not _HAS_CJK.match(word))
    alpha = [None] * (n + 1)
    alpha[0] = np.ones(prob.shape[1])
    for i, j, ids in vocab.arcs(word):
        if alpha[i] is not None:
            x = alpha[i] * prob[ids[0]] if len(ids) == 1 else alpha[i] * prob[ids].prod(axis=0)
            alpha[j] = x if alpha[j] is None else alpha[j] + x
    return np.log(np.maximum(alpha[n], 1e-290)) if alpha[n] is not None else np.full(prob.shape[1], -600.0)


def fit(counts: dict[str, Counter], vocab: Pieces, rounds: int = 2, floor: float = 1e-7) -> np.ndarray:
    """Piece probabilities (piece, language) by expectation-maximisation over word counts per language."""
    langs = list(LANGUAGES)
    words = sorted({w for c in counts.values() for w in c if len(w) <= MAX_WORD})
    n = np.array([[counts[lang].get(w, 0) for lang in langs] for w in words], np.float64).reshape(len(words), len(langs))
    arcs = [vocab.arcs(w) for w in words]
    prob = np.full((vocab.size, len(langs)), 1e-5)
    for number in range(rounds + 1):
        expected = np.zeros_like(prob)
        for k, a in enumerate(arcs):
            size = max(e for _, e, _ in a)
            weight = n[k]
            alpha = np.zeros((size + 1, len(langs)))
            beta = np.zeros((size + 1, len(langs)))
            alpha[0], beta[size] = 1.0, 1.0
            # the first round weighs a segmentation by its length alone: longer pieces win
            p = [(prob[ids[0]] if len(ids) == 1 else prob[ids].prod(axis=0)) if number else np.full(len(langs), 1e-3 ** len(ids)) for _, _, ids in a]
            for (i, j, _), x in zip(a, p, strict=True):
                alpha[j] += alpha[i] * x
            for (i, j, _), x in zip(reversed(a), reversed(p), strict=True):
                beta[i] += beta[j] * x
            total = np.maximum(alpha[size], 1e-290)
            for (i, j, ids), x in zip(a, p, strict=True):
                share = weight * alpha[i] * x * beta[j] / total
                for q in ids:
                    expected[q] += share
        prob = (expected + floor * np.maximum(expected.sum(axis=0), 1.0)) / np.maximum(expected.sum(axis=0), 1.0)
        prob /= prob.sum(axis=0)
    return prob


class Fitted(NamedTuple):
    """Piece probabilities (piece, language), and mean and variance of the scores of words by length (length, language)."""

    prob: np.ndarray
    mean: np.ndarray
    variance: np.ndarray


class Model:
    """Piece probabilities with a memory of word scores: log-probability, its mean and its variance, each by language."""

    def __init__(self, fitted: Fitted | np.ndarray, path: str) -> None:
        if not isinstance(fitted, Fitted):
            fitted = Fitted(fitted, np.zeros((2, fitted.shape[1])), np.ones((2, fitted.shape[1])))
        self.fitted, self.path = fitted, path
        self.rows: dict[str, int] = {}
        self.k = fitted.prob.shape[1]
        self.scores = np.zeros((1024, 3 * self.k))

    def word_rows(self, words: list[str]) -> list[int]:
        rows, out = self.rows, []
        for w in words:
            r = rows.get(w)
            if r is None:
                if len(rows) >= 500_000:
                    rows.clear()
                    return self.word_rows(words)
                r = len(rows)
                if r >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                n = min(len(w), len(self.fitted.mean) - 1)
                self.scores[r] = np.concatenate([forward(w, pieces(self.path), self.fitted.prob), self.fitted.mean[n], self.fitted.variance[n]])
                rows[w] = r
            out.append(r)
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of the words in each language."""
        return self.sums(words)[: self.k]

    def sums(self, words: list[str]) -> np.ndarray:
        rows = self.word_rows(words)
        return self.scores[rows].sum(axis=0) if rows else np.zeros(3 * self.k)

    def likeness(self, sums: np.ndarray, at: int, n: int) -> tuple[float, float]:
        """How far a text of ``n`` words lies above what its words would score in language ``at``: in standard deviations a word, and of the text."""
        z = float((sums[at] - sums[self.k + at]) / np.sqrt(max(sums[2 * self.k + at], 1.0)))
        return z / np.sqrt(max(n, 1)), z

    def unlike(self, sums: np.ndarray, at: int, n: int) -> bool:
        word, text = self.likeness(sums, at, n)
        return word < -UNLIKE and text < -UNLIKE_TEXT


def by_length(counts: dict[str, Counter], prob: np.ndarray, path: str) -> Fitted:
    """The model with mean and variance of word scores by length in each language; sparse lengths take the nearest filled one."""
    k = len(LANGUAGES)
    n, total, square = np.zeros((MAX_WORD + 1, k)), np.zeros((MAX_WORD + 1, k)), np.zeros((MAX_WORD + 1, k))
    model = Model(prob, path)
    for j, lang in enumerate(LANGUAGES):
        words = list(counts[lang])
        rows = model.word_rows(words)
        x = model.scores[rows, j]
        c = np.array([counts[lang][w] for w in words], np.float64)
        at = np.minimum(np.array([len(w) for w in words], np.int64), MAX_WORD)
        np.add.at(n[:, j], at, c), np.add.at(total[:, j], at, c * x), np.add.at(square[:, j], at, c * x * x)
    mean, variance = np.zeros_like(n), np.full_like(n, 100.0)
    for j in range(k):
        filled = np.flatnonzero(n[:, j] >= 20)
        if len(filled):
            nearest = filled[np.abs(np.arange(MAX_WORD + 1)[:, None] - filled[None, :]).argmin(axis=1)]
            m = total[nearest, j] / n[nearest, j]
            # beyond the filled lengths a word's score falls with each letter
            mean[:, j] = m * np.maximum(1.0, np.arange(MAX_WORD + 1) / nearest)
            variance[:, j] = np.maximum(square[nearest, j] / n[nearest, j] - m * m, 1.0)
    return Fitted(prob, mean, variance)


def confidence(scores: np.ndarray, at: int) -> float:
    """Tempered posterior of language ``at`` under equal priors."""
    z = (scores - scores.max()) * TEMPER
    return float(np.exp(z[at]) / np.exp(z).sum())


_TEXTS = "transform(coalesce(sections, array()), s -> struct(s.ordinal as ordinal, transform(coalesce(s.paragraphs, array()), p -> p.text) as paragraphs))"


def fit_model(parsed: DataFrame, *, path: str = VOCABULARY, sample: int = SAMPLE_DOCUMENTS) -> Fitted:
    """Fit on the ``sample`` labelled documents with the smallest hash, then drop the wrongly labelled ones and fit again.

    A threshold on the hash, from the number of labelled rows, leaves a little
    more than the sample before any text is read; so as many texts are sorted
    and sent to the driver, however many documents and partitions there are.
    """
    labelled = parsed.where("language is not null and trim(language) <> ''").withColumn("_h", F.expr("pmod(xxhash64(id), 1099511627776)"))
    total = labelled.select("id").count()
    least = 1 << 40 if total <= 2 * sample else int((1 << 40) * 1.25 * sample / total)
    text = F.expr("array_join(flatten(transform(coalesce(sections, array()), s -> transform(coalesce(s.paragraphs, array()), p -> p.text))), ' ')")
    rows = labelled.where(F.col("_h") < least).select("id", "language", "_h", text.alias("t")).orderBy("_h", "id").limit(sample).collect()
    docs = [(lang, [Counter(split_words(x)) for x in sentences(_BROKEN.sub("", r.t or ""))]) for r in rows if (lang := read_label(r.language))]
    return fit_sentences(docs, path)


def fit_sentences(docs: list[tuple[str, list[Counter]]], path: str) -> Fitted:
    """Fit by the documents' labels, relabel documents and their sentences, fit again.

    Languages of different scripts aren't mixed: ideographs count for Chinese, letters for the others.
    """
    vocab = pieces(path)
    labels = [[lang] * len(units) for lang, units in docs]
    prob = np.full((vocab.size, len(LANGUAGES)), 1.0 / vocab.size)
    for last in (False, True):
        counts = {lang: Counter() for lang in LANGUAGES}
        for langs, (_, units) in zip(labels, docs, strict=True):
            for lang, c in zip(langs, units, strict=True):
                counts[lang].update(c)
        for lang, c in counts.items():
            counts[lang] = Counter({w: n for w, n in c.items() if n > 1 and bool(_HAS_CJK.match(w)) == (lang == "zh")})
        prob = fit(counts, vocab, rounds=int(last))
        if last:
            break
        model = Model(prob, path)
        for k, (_, units) in enumerate(docs):
            sums = []
            for c in units:
                ws = list(c)
                at = model.word_rows(ws)
                sums.append((model.scores[at, : len(LANGUAGES)] * np.array([c[w] for w in ws])[:, None]).sum(axis=0) if ws else np.zeros(len(LANGUAGES)))
            if units:
                prior = np.zeros(len(LANGUAGES))
                prior[int(np.sum(sums, axis=0).argmax())] = MIN_MARGIN
                labels[k] = [LANGUAGES[int((x + prior).argmax())] for x in sums]
    return by_length(counts, prob, path)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and s.strip()]


def clean_lines(text: str, furniture: Furniture) -> str:
    """Text without running headers, its broken words joined."""
    if "\n" in text:
        text = "\n".join(line for line in text.split("\n") if not furniture.is_header(line))
    elif furniture.forms and sum(w in text for w in furniture.cues) >= 2:
        for a, b in reversed(furniture.inline(text)):
            text = text[:a] + " " + text[b:]
    return _BROKEN.sub("", text)


def label_documents(parsed: DataFrame, fitted: Fitted, *, path: str = VOCABULARY) -> DataFrame:
    """(document_id, label, lang, confidence, segments): the main language of each document and its foreign segments.

    A segment is a maximal run of sentences of one other language in a
    paragraph: (section_no, paragraph_no, lang, confidence, text).
    """
    sent = parsed.sparkSession.sparkContext.broadcast(tuple(fitted))  # size of the fixed vocabulary
    seg = "array<struct<section_no:int,paragraph_no:int,lang:string,confidence:double,text:string>>"
    kept: dict[str, Model] = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.get("m") or Model(Fitted(*sent.value), path)
        k = model.k
        kept["m"] = model
        for b in batches:
            out = []
            for row in b.to_pylist():
                furniture = Furniture(row["title"], None, [t for s in row["sections"] for t in (s or {}).get("paragraphs") or []])
                units = []
                for s in row["sections"]:
                    for n, t in enumerate((s or {}).get("paragraphs") or [], 1):
                        if t and t.strip():
                            for x in sentences(clean_lines(t, furniture)):
                                units.append((s["ordinal"], n, x, split_words(x)))
                if not any(u[3] for u in units):
                    out.append((row["id"], row["language"], None, 0.0, []))
                    continue
                rows = model.word_rows([w for u in units for w in u[3]])
                flat = model.scores[rows]
                if len(flat) != sum(len(u[3]) for u in units):
                    raise AssertionError("scores out of step")
                sums, at = [], 0
                for u in units:
                    sums.append(flat[at : at + len(u[3])].sum(axis=0))
                    at += len(u[3])
                total = np.sum(sums, axis=0)
                # the main language is the one of most of the text, not of the strongest sentence
                votes, best = np.zeros(k), [int(s[:k].argmax()) for s in sums]
                for u, j in zip(units, best, strict=True):
                    if u[3]:
                        votes[j] += _letters(u[3])
                main = int(votes.argmax()) if votes.max() > 0.6 * votes.sum() else int(total[:k].argmax())
                mine = [(s, len(u[3])) for u, s, j in zip(units, sums, best, strict=True) if j == main]
                own, n = np.sum([s for s, _ in mine], axis=0), sum(x for _, x in mine)
                unlike = bool(mine) and model.unlike(own, main, n)
                segments: list[list] = []
                for u, s, j in zip(units, sums, best, strict=True):
                    if _letters(u[3]) >= MIN_LETTERS and (s[j] - s[main] >= MIN_MARGIN if j != main and not unlike else unlike and model.likeness(s, j, len(u[3]))[0] > -UNLIKE / 2):
                        last = segments[-1] if segments else None
                        if last and last[0] == u[0] and last[1] == u[1] and last[2] == j and last[6]:
                            last[3], last[4], last[5] = last[3] + s, last[4] + len(u[3]), last[5] + " " + u[2]
                        else:
                            segments.append([u[0], u[1], j, s, len(u[3]), u[2], True])
                    elif segments:
                        segments[-1][6] = False
                found = [{"section_no": a, "paragraph_no": p, "lang": OTHER if model.unlike(s, j, c) else LANGUAGES[j], "confidence": confidence(s[:k], j), "text": t} for a, p, j, s, c, t, _ in segments]
                sure = float(1.0 / (1.0 + np.exp(max(model.likeness(own, main, n)[0] + UNLIKE, -500.0)))) if unlike else confidence(total[:k], main)
                out.append((row["id"], row["language"], OTHER if unlike else LANGUAGES[main], sure, found))
            kind = pa.list_(pa.struct([("section_no", pa.int32()), ("paragraph_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.string(), pa.string(), pa.string(), pa.float64(), kind])], names=["document_id", "label", "lang", "confidence", "segments"])

    docs = parsed.select("id", "language", "title", F.expr(_TEXTS).alias("sections"))
    return docs.mapInArrow(work, f"document_id string, label string, lang string, confidence double, segments {seg}")


def _letters(words: list[str]) -> int:
    return sum(MIN_LETTERS // 8 if len(w) == 1 and _HAS_CJK.match(w) else len(w) for w in words)


def language_cases(labelled: DataFrame) -> DataFrame:
    """(document_id, section_no, paragraph_no, lang): documents with a missing or wrong label (section and paragraph 0) and foreign segments."""
    notation = F.create_map(*[F.lit(x) for pair in _NAME.items() for x in pair])
    norm = F.lower(F.trim(F.regexp_replace("label", "_", "-")))
    said = F.coalesce(F.try_element_at(notation, norm), F.try_element_at(notation, F.split(norm, r"[-\s(]")[0]))
    entry = "array<struct<section_no:int,paragraph_no:int,lang:string>>"
    wrong = F.col("lang").isin(*LANGUAGES) & (said.isNull() | (said != F.col("lang")))
    whole = F.when(wrong, F.array(F.struct(F.lit(0).alias("section_no"), F.lit(0).alias("paragraph_no"), F.col("lang").alias("lang")))).otherwise(F.array()).cast(entry)
    parts = F.transform(F.filter("segments", lambda s: s["lang"] != OTHER), lambda s: F.struct(s["section_no"].alias("section_no"), s["paragraph_no"].alias("paragraph_no"), s["lang"].alias("lang"))).cast(entry)
    return labelled.select("document_id", F.explode(F.concat(whole, parts)).alias("c")).select("document_id", "c.section_no", "c.paragraph_no", "c.lang").distinct()
