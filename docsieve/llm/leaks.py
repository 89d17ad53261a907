"""Evaluation passages inside a training corpus (problem 9).

Each training shard gets an FM-index over its words: the Burrows-Wheeler
transform of the shard's word sequence, wavelet-matrix ranks, and suffix
positions sampled at every ``SAMPLE``-th place.  All windows of ``n`` words of
the test passages are searched backwards through the ranks at once; the
occurrences are located by walking to a sampled position, mapped to documents
and merged to spans.

Words are compared in canonical form (problem 10), case-folded, punctuation
and invisible characters left out; each ideograph is a word.  A run of fewer
than ``n`` words that occur in some passage can't hold a match and isn't
indexed; nothing else is left out, whatever the length of a document.

Defined results: null and empty texts hold nothing; passages of fewer than
``n`` words can't leak; equal passages each count; repeated rows of a document
give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docsieve.llm.canonical import canonical

SHARD_WORDS = 1_000_000  # words in one index; bounds a worker's memory
BLOCK_WORDS = 4_000_000  # words of passages sent to the executors at once: 16 MB of numbers beside their vocabulary
SAMPLE = 8

_CJK = "⺀-⿟々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
_ASCII = re.compile(r"[a-z0-9]+")
_WORDS = re.compile(f"[{_CJK}]|(?:(?![{_CJK}])[^\\W_])+")
_NO_CJK = re.compile(r"[^\W_]+")
_HAS_CJK = re.compile(f"[{_CJK}]")


def words(text: str | None) -> list[str]:
    """The words of ``text`` as they are compared."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = canonical(text).casefold()
    if text.isascii():
        return _ASCII.findall(text)
    return (_WORDS if _HAS_CJK.search(text) else _NO_CJK).findall(text)


class FMIndex:
    """FM-index of an integer sequence; 0 separates and never matches."""

    def __init__(self, seq: np.ndarray) -> None:
        seq = np.append(seq.astype(np.int64) + 1, 0)  # one end symbol, smaller than all others
        n = len(seq)
        self.n, self.bits = n, max(1, int(seq.max(initial=0)).bit_length())
        sa = self._suffixes(seq)
        bwt = seq[sa - 1]  # the suffix at 0 wraps to the end symbol
        self.start = np.searchsorted(np.sort(seq), np.arange(int(seq.max(initial=0)) + 2))
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        marked = sa % SAMPLE == 0
        self.rank_marked = np.zeros(n + 1, np.int32)
        np.cumsum(marked, out=self.rank_marked[1:])
        self.marked, self.sampled = marked, sa[marked]

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """All suffixes in order (prefix doubling, several symbols at once to begin with)."""
        n = len(seq)
        bits = int(seq.max(initial=0) + 1).bit_length()
        per = max(1, 62 // bits)
        padded = np.concatenate([seq.astype(np.int64) + 1, np.zeros(per, np.int64)])  # the end is smaller than any symbol
        key = np.zeros(n, np.int64)
        for k in range(per):
            key = (key << bits) | padded[k : k + n]
        h = per
        while True:
            sa = np.argsort(key, kind="stable")
            ordered = key[sa]
            rank_sorted = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if rank_sorted[-1] == n - 1:
                return sa
            rank = np.empty(n, np.int64)
            rank[sa] = rank_sorted
            shifted = np.zeros(n, np.int64)
            if h < n:
                shifted[: n - h] = rank[h:] + 1
            key = rank * (n + 1) + shifted
            h *= 2

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform, relative to its block start."""
        begin = np.zeros_like(i)
        for k in range(self.bits):
            ones, z = self.ones[k], self.zeros[k]
            bit = (symbol >> (self.bits - 1 - k)) & 1
            oi, ob = ones[i], ones[begin]
            i = np.where(bit, z + oi, i - oi)
            begin = np.where(bit, z + ob, begin - ob)
        return i - begin

    def search(self, words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern ``words[start:start + n]`` that occurs: (number of the pattern, lo, hi)."""
        alive, top = np.arange(len(starts)), len(self.start) - 2
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for k in range(n - 1, -1, -1):
            c = words[starts[alive] + k].astype(np.int64) + 1
            known = c <= top
            alive, c, lo, hi = alive[known], c[known], lo[known], hi[known]
            base = self.start[c]
            lo, hi = base + self.rank(c, lo), base + self.rank(c, hi)
            on = hi > lo
            alive, lo, hi = alive[on], lo[on], hi[on]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by stepping back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            hit = self.marked[at]
            out[todo[hit]] = self.sampled[self.rank_marked[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at]
            at = self.start[c] + self.rank(c, at)
            steps += 1
        return out


class Passages:
    """Test passages as numbered words, built once; equal passages are one.  The windows of ``n`` words begin at ``starts``."""

    def __init__(self, n: int) -> None:
        self.n, self.number, self.size = n, {}, 0
        self._texts: dict[bytes, int] = {}
        self._parts: list[np.ndarray] = []
        self.holders: list[list[object]] = []

    def add(self, item: object, text: str | None) -> None:
        w = words(text)
        if len(w) < self.n:
            return
        ids = np.fromiter((self.number.setdefault(x, len(self.number) + 1) for x in w), np.int32, len(w))
        at = self._texts.setdefault(ids.tobytes(), len(self._parts))
        if at == len(self._parts):
            self._parts.append(ids)
            self.holders.append([])
            self.size += len(ids)
        self.holders[at].append(item)

    def packed(self) -> tuple:
        """What is sent: the words in the order of their numbers, all passages' numbers, the ends of the passages, their items."""
        numbers = np.concatenate(self._parts) if self._parts else np.zeros(0, np.int32)
        return self.n, list(self.number), numbers, np.cumsum([len(p) for p in self._parts]), self.holders


class Windows:
    """Passages as the executors use them; one for each worker process and block."""

    def __init__(self, n: int, vocabulary: list[str], numbers: np.ndarray, ends: np.ndarray, holders: list[list[object]]) -> None:
        self.n, self.numbers, self.holders = n, numbers, holders
        self.number = {w: i for i, w in enumerate(vocabulary, 1)}
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(numbers)) if len(ends) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(left >= n)
        self.passage = np.searchsorted(ends, self.starts, side="right") if len(ends) else self.starts


def _scan(passages: Windows, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, object, int, int]]:
    """(row, item, first word, end) of every merged span in one shard; docs: (row, word numbers, word places)."""
    seq = np.concatenate([x for _, ids, _ in docs for x in (ids, np.zeros(1, np.int64))])
    place = np.concatenate([x for _, _, at in docs for x in (at, np.zeros(1, np.int64))])
    row = np.repeat([r for r, _, _ in docs], [len(ids) + 1 for _, ids, _ in docs])
    index = FMIndex(seq)
    found, lo, hi = index.search(passages.numbers, passages.starts, passages.n)
    if not len(found):
        return
    width = hi - lo
    which = np.repeat(found, width)
    rows = np.repeat(lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    where = index.locate(rows)
    row, place, passage = row[where], place[where], passages.passage[which]
    order = np.lexsort((place, passage, row))
    row, place, passage = row[order], place[order], passage[order]
    first = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(passage) != 0) | (np.diff(place) > passages.n)])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(row)) - 1
    for r, p, a, b in zip(row[begin].tolist(), passage[begin].tolist(), place[begin].tolist(), (place[end] + passages.n).tolist(), strict=True):
        for item in passages.holders[p]:
            yield r, item, a, b


_KEPT: dict[int, Windows] = {}  # of this worker process, by broadcast


def leak_spans(corpus: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", n: int = 25) -> DataFrame:
    """(key, item_key, word_start, word_end): merged spans of at least ``n`` words of a passage.

    The passages are a stated query set.  They are numbered once on the driver
    and sent to the executors in blocks of at most ``BLOCK_WORDS`` words, each
    block against all rows.
    """
    spark = corpus.sparkSession
    kind, item_kind = corpus.schema[key].dataType, items.schema[item_key].dataType
    out_item = to_arrow_type(item_kind)

    def run(block: Passages) -> DataFrame:
        sent = spark.sparkContext.broadcast(block.packed())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = _KEPT.get(id(sent.value))
            if passages is None:
                _KEPT.clear()
                passages = _KEPT[id(sent.value)] = Windows(*sent.value)
            get = passages.number.get
            docs, keys, size, out_key = [], [], 0, pa.string()

            def flush() -> pa.RecordBatch:
                hits = list(_scan(passages, docs)) if len(passages.starts) else []
                columns = [pa.array([keys[r] for r, *_ in hits], out_key), pa.array([i for _, i, *_ in hits], out_item), pa.array([a for *_, a, _ in hits], pa.int32()), pa.array([b for *_, b in hits], pa.int32())]
                return pa.RecordBatch.from_arrays(columns, names=[key, item_key, "word_start", "word_end"])

            for b in batches:
                out_key = b.schema.field(0).type
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = words(t)
                    if len(w) < n:
                        continue
                    ids = np.fromiter([get(x, 0) for x in w], np.int64, len(w))
                    if not ids.any():
                        continue
                    ids, at = _long_runs(ids, n)
                    if len(ids):
                        docs.append((len(keys), ids, at))
                        keys.append(k)
                        size += len(ids) + 1
                        if size >= SHARD_WORDS:
                            yield flush()
                            docs.clear(), keys.clear()
                            size = 0
            if docs:
                yield flush()

        return corpus.select(F.col(key), F.col(text)).mapInArrow(search, f"`{key}` {kind.simpleString()}, `{item_key}` {item_kind.simpleString()}, word_start int, word_end int")

    result, block = None, Passages(n)
    for r in items.select(item_key, passage).toLocalIterator():
        block.add(r[0], r[1])
        if block.size >= BLOCK_WORDS:
            result = run(block) if result is None else result.unionByName(run(block))
            block = Passages(n)
    if block.size or result is None:
        result = run(block) if result is None else result.unionByName(run(block))
    return result


def _long_runs(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least ``n`` known words with one separator after each, and the word places."""
    known = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= n
    if not long.any():
        return ids[:0], ids[:0]
    keep = np.zeros(len(ids) + 1, bool)
    for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        keep[a : b + 1] = True
    at = np.flatnonzero(keep)
    return np.append(ids, 0)[at], at


def leaks(corpus: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(key, item_key): every document with the items that leaked into it."""
    key, item_key = options.get("key", "doc_id"), options.get("item_key", "item_id")
    return leak_spans(corpus, items, **options).select(key, item_key).distinct()
