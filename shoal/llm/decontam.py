"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._words import text_column

K1, B = 1.2, 0.75
#: A passage must reach this share of an item's score against itself, this share of its question's shingles, and this share of its answer's.
SCORE, OVERLAP, ANSWER, SHINGLE = 0.5, 0.8, 0.5, 5
#: Items of a posting block (small, so that few terms of a passage meet in one); characters of items in one index; least passage stride in words; passages looked at in one go; the share of SCORE below which a passage's weakest terms stay together.
BLOCK, INDEX_CHARS, STRIDE, AT_ONCE, WEAK = 4, 32_000_000, 64, 256, 0.5

_word = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def shingles(words: list, width: int = SHINGLE) -> set[tuple]:
    """Word shingles; of fewer words the whole sequence, of none nothing."""
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before and in the last line, or the last sentence of a single line."""
    text = text.rstrip()
    for cut in (text.rfind("\n"), max(text.rfind(x, 0, -1) for x in (". ", "? ", "! "))):
        if cut > 0:
            return words_of(text[: cut + 1]), words_of(text[cut + 1 :])
    return words_of(text), []


@dataclass
class Statistics:
    """What BM25 needs of all items, however many indexes they are spread over."""

    df: Counter = field(default_factory=Counter)
    items: int = 0
    words: int = 0

    def add(self, items: list[tuple[int, str]]) -> None:
        for _, text in _distinct(items):
            bag = words_of(text)
            self.df.update(set(bag))
            self.items, self.words = self.items + 1, self.words + len(bag)


def _distinct(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return sorted({(i, t) for i, t in items if t and words_of(t)}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


class ItemIndex:
    """Inverted index whose impacts are BM25 shares of each item's score against itself.

    All of it is in flat arrays: an item's words as numbers (``words`` from ``begin``
    on), a term's blocks with their maxima (``block``, ``most`` from ``at`` on), and the
    postings of each (term, block) (``item``, ``impact`` from ``first`` on).
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        items = _distinct(items)
        if statistics is None:
            statistics = Statistics()
            statistics.add(items)
        self.ids = [i for i, _ in items]
        parts = [question_and_answer(t) for _, t in items]
        bags = [q + a for q, a in parts]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        self.longest = max(map(len, bags), default=0)
        self.begin = np.cumsum([0, *map(len, bags)])
        self.answer = np.array([len(q) for q, _ in parts], dtype=np.int64)
        self.words = np.fromiter((self.vocabulary[w] for b in bags for w in b), dtype=np.int32, count=int(self.begin[-1]))
        n, mean, df = statistics.items, statistics.words / max(1, statistics.items), statistics.df
        idf = np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in self.vocabulary])
        of = np.repeat(np.arange(len(bags)), np.diff(self.begin))
        key, tf = np.unique(self.words.astype(np.int64) * max(1, len(bags)) + of, return_counts=True)  # by term, then item
        term, self.item = key // max(1, len(bags)), (key % max(1, len(bags))).astype(np.int32)
        length = np.diff(self.begin)[self.item]
        raw = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))
        self.impact = raw / np.bincount(self.item, weights=raw, minlength=len(bags))[self.item]
        self.blocks = max(1, -(-len(bags) // BLOCK))
        self.entry, first = np.unique(term * self.blocks + self.item // BLOCK, return_index=True)
        self.first = np.append(first, len(key))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.block = self.entry % self.blocks
        self.at = np.searchsorted(self.entry // self.blocks, np.arange(len(self.vocabulary) + 1))
        self.top = np.maximum.reduceat(self.most, self.at[:-1]) if len(self.most) else np.zeros(0)

    def open_blocks(self, window: np.ndarray, terms: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """The blocks in which a passage may reach ``least``: (passage, its terms, blocks).

        ``window`` and ``terms`` are parallel, sorted by passage, each term once. The
        weakest terms of a passage, whose maxima together stay well below ``least``,
        can't bring an item there alone: only blocks with one of the others are looked
        at, and the weak terms' maxima only of blocks that the others leave within reach.
        """
        if not len(window):
            return
        order = np.lexsort((self.top[terms], window))
        window, terms = window[order], terms[order]
        cut = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1], [True])))
        row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        run = np.cumsum(self.top[terms])
        run -= np.concatenate(([0.0], run))[cut[:-1]][row]
        strong = run >= WEAK * least - 1e-4
        met, bound = self._sums(row, terms, strong)
        weak = np.bincount(row, weights=np.where(strong, 0.0, self.top[terms]), minlength=len(cut) - 1)
        left = bound + weak[met // self.blocks] >= least - 1e-4
        met, bound = met[left], bound[left]
        if len(met):
            some, more = self._sums(row, terms, ~strong & np.isin(row, met // self.blocks))
            if len(some):
                at = np.minimum(np.searchsorted(some, met), len(some) - 1)
                bound = bound + np.where(some[at] == met, more[at], 0.0)
            met = met[bound >= least - 1e-4]
        edge = np.flatnonzero(np.concatenate(([True], met[1:] // self.blocks != met[:-1] // self.blocks, [True]))) if len(met) else []
        for s, e in zip(edge[:-1], edge[1:]):
            k = int(met[s]) // self.blocks
            yield int(window[cut[k]]), np.sort(terms[cut[k] : cut[k + 1]]), (met[s:e] % self.blocks).tolist()

    def _sums(self, row: np.ndarray, terms: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the block maxima of those terms: (passage and block as one number, ascending; sum)."""
        low, high = self.at[terms[which]], self.at[terms[which] + 1]
        size = high - low
        entry = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = np.repeat(row[which], size) * self.blocks + self.block[entry]
        span = int(row[-1] + 1) * self.blocks
        if span <= 4 * len(key) + 1024:  # few blocks: all of them in one array
            total = np.bincount(key, weights=self.most[entry], minlength=span)
            met = np.flatnonzero(total)
            return met, total[met]
        met, place = np.unique(key, return_inverse=True)
        return met, np.bincount(place, weights=self.most[entry], minlength=len(met))

    def search(self, terms: np.ndarray, blocks: list[int], least: float) -> list[tuple[int, float]]:
        """All items of the blocks that the distinct terms score at ``least`` or above: (place, score)."""
        found = []
        for block in blocks:
            at = np.searchsorted(self.entry, terms * self.blocks + block)
            at = at[(at < len(self.entry)) & (self.entry[np.minimum(at, len(self.entry) - 1)] == terms * self.blocks + block)]
            if self.most[at].sum() < least - 1e-4:
                continue
            cursors = []  # [item, upper bound, items, impacts, place in them], by item
            for bound, s, e in zip(self.most[at].tolist(), self.first[at].tolist(), self.first[at + 1].tolist()):
                row = self.item[s:e].tolist()
                cursors.append([row[0], bound, row, self.impact[s:e].tolist(), 0])
            while cursors:
                cursors.sort(key=lambda c: c[0])
                total, pivot = 0.0, None
                for c in cursors:
                    total += c[1]
                    if total >= least - 1e-4:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if cursors[0][0] == pivot:
                    score = 0.0
                    for c in cursors:
                        if c[0] == pivot:
                            score += c[3][c[4]]
                            c[4] += 1
                    if score >= least:
                        found.append((pivot, score))
                else:
                    for c in cursors:
                        if c[0] < pivot:
                            c[4] = bisect_left(c[2], pivot, c[4])
                cursors = [c for c in cursors if c[4] < len(c[2])]
                for c in cursors:
                    c[0] = c[2][c[4]]
        return found

    def leaks(self, text: str, least: float = SCORE, overlap: float = OVERLAP, answer: float = ANSWER) -> list[tuple]:
        """Items that the text holds: (id, score, overlap, question's, answer's, first word, end word).

        Of the passages with an item's question and answer that with the largest
        overlap counts, of equal ones that with the larger score, then the first.
        """
        words = words_of(text)
        get = self.vocabulary.get
        terms = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        hits = np.flatnonzero(terms >= 0)
        if not len(hits):
            return []
        stride = max(STRIDE, self.longest)
        segment = hits // stride
        last = max(0, -(-len(words) // stride) - 2)  # passage k is segments k and k + 1, so each run of `stride` words is within one
        best: dict[int, tuple] = {}
        for low in range(0, last + 1, AT_ONCE):  # passages of this part; a long text's arrays are bounded by it
            near = (segment >= low) & (segment <= low + AT_ONCE)
            seg, term = segment[near], terms[hits[near]]
            window = np.concatenate([np.minimum(seg, last), seg[seg > 0] - 1])
            term = np.concatenate([term, term[seg > 0]])
            inside = (window >= low) & (window < low + AT_ONCE)
            keys = np.unique(window[inside] * len(self.vocabulary) + term[inside])
            for k, some, blocks in self.open_blocks(keys // len(self.vocabulary), keys % len(self.vocabulary), least):
                found = self.search(some, blocks, least)
                if not found:
                    continue
                start = k * stride
                passage = terms[start : start + 2 * stride].tolist()
                there = shingles(passage)
                for at, score in found:
                    item = self.words[self.begin[at] : self.begin[at + 1]].tolist()
                    cut = int(self.answer[at])
                    share, q, a = (_share(shingles(x), there, passage) for x in (item, item[:cut], item[cut:]))
                    if q >= overlap and a >= answer and (at not in best or (share, score) > (best[at][2], best[at][1])):
                        best[at] = (self.ids[at], score, share, q, a, start, start + len(passage))
        return [best[at] for at in sorted(best)]


def _share(wanted: set[tuple], there: set[tuple], words: list) -> float:
    """Share of the wanted shingles that stand in the passage; 1 if none is wanted."""
    if not wanted:
        return 1.0
    one = next(iter(wanted))
    if len(one) < SHINGLE:  # too short to be cut
        n = len(one)
        return float(any(tuple(words[i : i + n]) == one for i in range(len(words) - n + 1)))
    return len(wanted & there) / len(wanted)


_LEAK = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, word_start long, word_end long"


def _indexes(benchmark: DataFrame, chars: int = INDEX_CHARS) -> Iterator:
    """Broadcast indexes of the items, in shards of about ``chars`` characters, all with the statistics of the whole benchmark."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // chars))
    items = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard")).where(F.length("text") > 0)
    shard = lambda k: [(r["item_id"], r["text"]) for r in items.where(F.col("shard") == k).collect()]
    statistics = Statistics()
    for k in range(shards if shards > 1 else 0):
        statistics.add(shard(k))
    for k in range(shards):
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex(shard(k), statistics if shards > 1 else None))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, overlap: float = OVERLAP, answer: float = ANSWER, chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, scores, place) for each benchmark item that a document holds.

    Whole texts are searched in passages that overlap by half, so each item lies
    within one. What scores ``least`` or more is verified: ``overlap`` of the shingles
    of an item's question and ``answer`` of those of its answer (an item without an
    answer: its question) must stand in the passage. Items are indexed in shards of at
    most ``chars`` characters, each searched by all passages and with the same
    statistics. Null and empty texts and items without a word match nothing; repeated
    items count once; repeated rows and rows without doc_id each give their own
    matches. Other columns are ignored; empty tables give an empty result.
    """
    found = None
    for index in _indexes(benchmark, chars):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            idx = index.value
            for b in batches:
                ids = b.column(0).cast(pa.int64()).to_pylist()
                rows = [(i, *leak) for i, t in zip(ids, text_column(b.column(1))) for leak in idx.leaks(t.as_py(), least, overlap, answer)]
                if rows:
                    types = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=[x.split()[0] for x in _LEAK.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(run, _LEAK)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, overlap: float = OVERLAP, answer: float = ANSWER) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text holds no benchmark item."""
    at, schema = docs.columns.index("text"), docs.schema
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            idx = index.value
            for b in batches:
                yield b.filter(pa.array([not idx.leaks(t.as_py(), least, overlap, answer) for t in text_column(b.column(at))], type=pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
