"""Long exact spans shared between records (problem 2).

A span counts if it has at least ``length`` characters and stands, code point
by code point, within one paragraph of another document.

1. Anchors: every stretch of ``length`` characters holds at least one window
   minimum of its ``GRAM``-character hashes, the same one wherever it stands.
2. Anchors of one document only are dropped (minimum and maximum document per
   anchor, combined map-side).
3. Anchors that always stand together form a chain.  The text around a chain
   that any span over it can reach goes to the chain's reference shard, equal
   contexts once.  The shard's generalised
   suffix automaton, its states marked with the documents they occur in, is
   streamed with each context for matching statistics: how far back from each
   position the text stands in another document too.
4. A shard of more than ``SHARD`` different contexts is not built in one task:
   its windows of ``length`` characters are grouped by a hash of 128 bits
   instead, which finds the same positions by a plain aggregation.
5. Maximal stretches at or above the threshold are joined to their paragraphs
   and merged.

Defined results: null paragraphs and texts below the threshold share nothing;
rows that repeat a document's id are one document; a span that occurs twice in
one document only is not shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.sources.settle import settle

LENGTH = 200
GRAM = 96  # long enough that phrases of one kind of text rarely fill it, short enough that anchors stay sparse
SHARD = 512
BROADCAST_ROWS = 200_000  # rows of a written list up to which it is sent to the executors


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public constants of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` symbols from each place on; the last places hash what is left."""
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        power, out, done = _mix(codes.astype(np.uint64) + np.uint64(1)), None, 0
        mult, span = base, 1
        left = size
        while left:
            if left & 1:
                if out is None:
                    out = power.copy()
                else:
                    tail = np.zeros_like(out)
                    if done < len(codes):
                        tail[: len(codes) - done] = power[done:]
                    out = out * mult + tail
                done += span
            left >>= 1
            if left:
                shifted = np.zeros_like(power)
                if span < len(codes):
                    shifted[: len(codes) - span] = power[span:]
                power = power * mult + shifted
                mult = mult * mult
                span *= 2
        return _mix(out)


def _slide(values: np.ndarray, width: int, op: np.ufunc, fill: np.uint64, backward: bool = False) -> np.ndarray:
    """op over the ``width`` places from each place on (or up to it)."""
    if backward:
        return _slide(values[::-1], width, op, fill)[::-1]
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(out, fill)
        if step < len(out):
            moved[: len(out) - step] = out[step:]
        out = op(out, moved)
        have += step
    return out


def anchors_of(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of every anchor of the texts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts_at = [i for i, t in enumerate(texts) if t and len(t) >= length]
    if not texts_at:
        return none
    sizes = np.array([len(texts[i]) for i in texts_at], np.int64)
    codes = np.frombuffer("".join([texts[i] for i in texts_at]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    window = length - gram + 1
    h = gram_hashes(codes, gram)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the end of the text
    low = _slide(h, window, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    low[left < length] = 0  # no window of this text begins here
    high = _slide(low, window, np.maximum, np.uint64(0), backward=True)
    # a window of another text is never taken for one of this: it ends before this text begins or begins after it
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    picked = (high == h) & (left >= gram)
    at = np.flatnonzero(picked)
    if len(at):
        text_no = np.searchsorted(ends, at, side="right")
        return np.array(texts_at, np.int64)[text_no], place[at], h[at].view(np.int64)
    return none


class Automaton:
    """Generalised suffix automaton; each state knows the smallest and largest document it occurs in."""

    __slots__ = ("next", "link", "len", "lo", "hi")

    def __init__(self) -> None:
        self.next, self.link, self.len, self.lo, self.hi = [{}], [-1], [0], [None], [None]

    def add(self, text: str, lo: int, hi: int) -> list[int]:
        """Add a text that stands in documents ``lo`` to ``hi``; its state after each character."""
        nxt, link, length = self.next, self.link, self.len
        last, path = 0, []
        for ch in text:
            q = nxt[last].get(ch)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, ch)
            else:
                cur = len(length)
                nxt.append({}), link.append(0), length.append(length[last] + 1), self.lo.append(None), self.hi.append(None)
                p = last
                while p != -1 and ch not in nxt[p]:
                    nxt[p][ch] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][ch]
                    link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, ch)
                last = cur
            path.append(last)
        self._mark(path, lo, hi)
        return path

    def _clone(self, p: int, q: int, ch: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(length)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        self.lo.append(self.lo[q]), self.hi.append(self.hi[q])
        link[q] = c
        while p != -1 and nxt[p].get(ch) == q:
            nxt[p][ch] = c
            p = link[p]
        return c

    def _mark(self, path: list[int], lo: int, hi: int) -> None:
        for s in path:
            while s > 0:
                a, b = self.lo[s], self.hi[s]
                if a is not None and a <= lo and b >= hi:
                    break
                self.lo[s] = lo if a is None or lo < a else a
                self.hi[s] = hi if b is None or hi > b else b
                s = self.link[s]

    def statistics(self, text: str, doc_lo: int, doc_hi: int) -> list[int]:
        """For each end position the longest stretch up to it that also stands in a document other than this one.

        A text that stands in two documents itself is shared throughout.
        """
        if doc_lo != doc_hi:
            return list(range(1, len(text) + 1))
        nxt, link, length, lo, hi = self.next, self.link, self.len, self.lo, self.hi
        out, s, have = [], 0, 0
        for ch in text:
            while s and ch not in nxt[s]:
                s = link[s]
                have = length[s]
            t = nxt[s].get(ch)
            s, have = (t, have + 1) if t is not None else (0, 0)
            r, reach = s, have
            while r > 0 and lo[r] == hi[r] == doc_lo:
                r = link[r]
                reach = length[r]
            out.append(reach if r > 0 else 0)
            if r != s:  # what is lost for this document stays lost for longer stretches
                s, have = r, reach if r > 0 else 0
        return out


def _stretches(reach: list[int], length: int) -> list[tuple[int, int]]:
    """Union of the stretches [end - reach, end) of at least ``length``."""
    out: list[list[int]] = []
    for e, r in enumerate(reach, 1):
        if r >= length:
            if out and e - r <= out[-1][1]:
                out[-1][0] = min(out[-1][0], e - r)
                out[-1][1] = e
            else:
                out.append([e - r, e])
    return [(a, b) for a, b in out]


CORE = "\U0010fffd"  # stands for the text that all contexts of a shard have between their outer anchors


def shard_spans(contexts: list[tuple[int, str, int, int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(context number, start, end) of the shared stretches in one shard.

    contexts: (number, text, lowest, highest document, core start, core end).
    Where the core is the same in all, each stretch over it covers it whole,
    so one symbol stands for it in the automaton and streams.
    """
    if all(lo != hi for _, _, lo, hi, _, _ in contexts):
        return [(k, 0, len(text)) for k, text, *_ in contexts if len(text) >= length]
    if len(contexts) == 1:
        return []
    cores = {text[a:b] for _, text, _, _, a, b in contexts}
    fold = len(cores) == 1 and len(next(iter(cores))) > 1 and not any(CORE in text for _, text, *_ in contexts)
    skip = len(next(iter(cores))) - 1 if fold else 0
    short = [text[:a] + CORE + text[b:] if fold else text for _, text, _, _, a, b in contexts]
    sam = Automaton()
    for text, (_, _, lo, hi, _, _) in zip(short, contexts, strict=True):
        sam.add(text, lo, hi)
    out = []
    for text, (k, _, lo, hi, a, _) in zip(short, contexts, strict=True):
        reach = sam.statistics(text, lo, hi)
        if fold:  # back to characters: only stretches over the core count here, all others have their own anchor
            whole = [(e - r, e + skip) for e, r in enumerate(reach, 1) if e > a >= e - r and r + skip >= length]
            out += [(k, x, y) for x, y in _union(whole)]
        else:
            out += [(k, x, y) for x, y in _stretches(reach, length)]
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def paragraphs(parsed: DataFrame) -> DataFrame:
    """(document_id, section_no, paragraph_no, text): one row for each paragraph of each parsed document."""
    s = parsed.select("id", F.explode("sections").alias("s"))
    p = s.select(F.col("id").alias("document_id"), F.col("s.ordinal").alias("section_no"), F.posexplode("s.paragraphs").alias("_n", "_p"))
    return p.select("document_id", "section_no", (F.col("_n") + 1).alias("paragraph_no"), F.col("_p.text").alias("text"))


def shared_spans(texts: DataFrame, group: str, keys: list[str], text: str, *, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(group, keys.., _spans): the spans (span_start, span_end) of a text that stand in a text of another ``group``; they may overlap.

    Repeated rows need not be removed before: they are one text of one group,
    and only their contexts are compared.
    """
    named = texts.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(group, *keys, F.col(text).alias("_t"))
    long = named.where(F.length("_t") >= length).withColumn("_doc", F.xxhash64(group)).withColumn("_par", F.xxhash64(group, *keys, "_t"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no, place, h = anchors_of(b.column(2).to_pylist(), length, gram)
            take = pa.array(no)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(h), pa.array(place.astype(np.int32))], names=["_doc", "_par", "_anchor", "_at"])

    found = settle(long.select("_doc", "_par", "_t").mapInArrow(find, "_doc bigint, _par bigint, _anchor bigint, _at int"), "span-anchors")
    several = found.groupBy("_anchor").agg(F.min("_doc").alias("_lo"), F.max("_doc").alias("_hi")).where("_lo <> _hi").select("_anchor")
    hits = settle(found.join(_near(settle(several, "span-shared")), "_anchor", "left_semi").distinct(), "span-hits")
    chains = _near(settle(_chains(hits, gram), "span-chains"))
    around = "struct(greatest(0, w._first + {0} - {1}) as _from, w._last - {0} + {1} as _to)".format(gram, length)
    near = long.select("_par", "_doc", group, *keys, "_t").join(chains, "_par").select("_par", "_doc", group, *keys, "_t", F.explode("_chains").alias("w"))
    cut = near.select("_par", "_doc", group, *keys, F.col("w._chain").alias("_chain"), "_t", "w", F.expr(around).alias("r"))
    ctx = cut.select(
        "_par", "_doc", group, *keys, "_chain", F.col("r._from").alias("_from"),
        F.expr("w._first - r._from").alias("_c0"), F.expr("w._last - r._from").alias("_c1"), F.expr("substring(_t, r._from + 1, r._to - r._from)").alias("_ctx"),
    )
    ctx = settle(ctx.distinct().withColumn("_key", F.xxhash64("_chain", "_ctx", "_c0")), "span-contexts")
    different = ctx.groupBy("_chain", "_key").agg(F.first(F.struct("_ctx", "_c0", "_c1")).alias("x"), F.min("_doc").alias("_lo"), F.max("_doc").alias("_hi"))
    different = settle(different.select("_chain", "_key", "x._ctx", "_lo", "_hi", "x._c0", "x._c1"), "span-shards")
    big = different.groupBy("_chain").count().where(F.col("count") > shard).select("_chain")
    small = different.join(big, "_chain", "left_anti").repartition("_chain").sortWithinPartitions("_chain", "_key")

    def automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []

        def done() -> pa.RecordBatch:
            spans = shard_spans(block, length)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(spans), pa.int64()), pa.array([k for k, _, _ in spans], pa.int64()), pa.array([a for _, a, _ in spans], pa.int32()), pa.array([e for *_, e in spans], pa.int32())], names=["_chain", "_key", "_a", "_b"])

        for b in batches:
            for chain, key, t, lo, hi, c0, c1 in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if chain != now:
                    if block:
                        yield done()
                    now, block = chain, []
                block.append((key, t, lo, hi, c0, c1))
        if block:
            yield done()

    by_shard = small.mapInArrow(automata, "_chain bigint, _key bigint, _a int, _b int")
    windows = different.join(big, "_chain", "left_semi").where(F.length("_ctx") >= length).select("_chain", "_key", "_lo", "_hi", F.explode(F.expr(f"sequence(0, length(_ctx) - {length})")).alias("_a"), "_ctx")
    window = F.expr(f"substring(_ctx, _a + 1, {length})")
    windows = windows.select("_chain", "_key", "_lo", "_hi", "_a", F.xxhash64(window).alias("_g"), F.xxhash64(F.lit(1), window).alias("_h"))
    grams = windows.groupBy("_chain", "_g", "_h").agg(F.min("_lo").alias("_x"), F.max("_hi").alias("_y")).where("_x <> _y").select("_chain", "_g", "_h")
    by_gram = windows.join(grams, ["_chain", "_g", "_h"], "left_semi").select("_chain", "_key", "_a", (F.col("_a") + length).alias("_b"))
    spans = by_shard.unionByName(by_gram)
    placed = ctx.select("_chain", "_key", "_par", group, *keys, "_from").join(spans, ["_chain", "_key"])
    placed = placed.select("_par", group, *keys, F.struct((F.col("_from") + F.col("_a")).alias("span_start"), (F.col("_from") + F.col("_b")).alias("span_end")).alias("s"))
    return placed.groupBy("_par", group, *keys).agg(F.collect_set("s").alias("_spans")).drop("_par")  # at most a few for each place of one text


def _near(df: DataFrame) -> DataFrame:
    """Sent to the executors if its size, which is counted, allows; joined by a shuffle beyond that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _chains(hits: DataFrame, gram: int) -> DataFrame:
    """(_par, _chains): the shared anchors of each text, those that always stand together as one chain.

    Two neighbouring anchors are linked if every occurrence of either has the
    other at the same distance; so a chain is the same wherever it occurs and
    its first anchor names it.
    """
    by_text = W.partitionBy("_par").orderBy("_at", "_anchor")
    step = hits.withColumn("_next", F.lead("_anchor").over(by_text)).withColumn("_gap", F.lead("_at").over(by_text) - F.col("_at"))
    n = hits.groupBy("_anchor").agg(F.count("*").alias("_n"))
    pairs = step.where("_next is not null").groupBy("_anchor", "_next", "_gap").agg(F.count("*").alias("_e"))
    linked = pairs.join(n, "_anchor").where("_e = _n").drop("_n").join(n.select(F.col("_anchor").alias("_next"), "_n"), "_next").where("_e = _n").select("_anchor", "_next", "_gap", F.lit(True).alias("_link"))
    marked = step.join(linked, ["_anchor", "_next", "_gap"], "left").select("_par", "_at", "_anchor", F.coalesce("_link", F.lit(False)).alias("_link"))
    numbered = marked.withColumn("_begin", ~F.coalesce(F.lag("_link").over(by_text), F.lit(False))).withColumn("_no", F.sum(F.col("_begin").cast("int")).over(by_text))
    chain = numbered.groupBy("_par", "_no").agg(F.min(F.struct("_at", "_anchor")).alias("_f"), F.max("_at").alias("_l"))
    return chain.groupBy("_par").agg(F.collect_list(F.struct(F.col("_f._anchor").alias("_chain"), F.col("_f._at").alias("_first"), (F.col("_l") + gram).alias("_last"))).alias("_chains"))  # at most the length of one text


_UNION = """aggregate(array_sort(_spans), named_struct('n', 0, 'e', 0),
 (acc, x) -> named_struct('n', acc.n + greatest(0, x.span_end - greatest(acc.e, x.span_start)), 'e', greatest(acc.e, x.span_end)), acc -> acc.n)"""


def shared_by_paragraph(parsed: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(document_id, section_no, paragraph_no, shared_chars) of every paragraph that shares a span."""
    spans = shared_spans(paragraphs(parsed.select("id", "sections")), "document_id", ["section_no", "paragraph_no"], "text", length=length)
    return spans.select("document_id", "section_no", "paragraph_no", F.expr(_UNION).alias("shared_chars")).groupBy("document_id", "section_no", "paragraph_no").agg(F.max("shared_chars").alias("shared_chars"))
