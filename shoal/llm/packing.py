"""Best-fit packing of tokenised documents into sequences, as vector bin packing.

Lengths run from 1 to the sequence size, so what the packer must know of any corpus
is a histogram of at most that many counts. It is packed on the driver as groups of
like bins; pieces then find their place by their rank among pieces of their length,
which is worked out in salted groups on the cluster.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm._base import materialise, partitions
from shoal.llm._words import chunks, split_words, text_column

#: Bytes of text whose words are looked up together; words, and parts of words, that a worker keeps with their ids.
CHUNK, KEPT_WORDS, KEPT_PARTS = 8_000_000, 100_000, 150_000

#: Fixed value: the tokenizer's own pattern of parts, which it applies in lower case.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 2048
    docs: int = 2048
    attention: int = 2048 * 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.docs, self.attention], dtype=np.int64)


def demand(length: int) -> np.ndarray:
    return np.array([1, 0, 0], dtype=np.int64) * length + np.array([0, 1, length * length], dtype=np.int64)


def pack_histogram(counts: dict[int, int], capacity: Capacity = Capacity(), weights=(1.0, 0.05, 0.2), rule: str = "norm") -> list[tuple[int, ...]]:
    """Vector best-fit over length counts, longest first.

    Gives rows (length, first rank, end rank, first sequence, copies a sequence,
    offset): of the pieces of that length, those of these ranks go to consecutive
    sequences, so many to each, from that offset on. ``rule`` picks among the bins
    that satisfy every constraint: "norm" takes the least weighted norm of what
    would be left, "dot" the largest weighted dot product of demand and what is left.
    Lengths beyond a capacity can't be placed and raise ValueError.
    """
    full, w = capacity.vector(), np.asarray(weights, dtype=float)
    left, many, first = np.zeros((64, 3), dtype=np.int64), np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int64)
    n = used = 0
    rows: list[tuple[int, ...]] = []

    def add(rest: np.ndarray, count: int, at: int) -> None:
        nonlocal left, many, first, n
        if n == len(left):
            live = np.flatnonzero((left[:n, 0] > 0) & (left[:n, 1] > 0) & (many[:n] > 0))
            left[: len(live)], many[: len(live)], first[: len(live)] = left[live], many[live], first[live]
            n = len(live)
            if 2 * n > len(left):
                left, many, first = (np.concatenate([x, np.zeros_like(x)]) for x in (left, many, first))
        left[n], many[n], first[n] = rest, count, at
        n += 1

    for length in sorted(counts, reverse=True):
        need, todo, rank = demand(length), counts[length], 0
        if todo and (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        while todo:
            fits = np.flatnonzero((many[:n] > 0) & (left[:n] >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    g = fits[np.argmin((((left[fits] - need) / full * w) ** 2).sum(axis=1))]
                else:
                    g = fits[np.argmax((left[fits] / full * (need / full) * w).sum(axis=1))]
                rest, bins, at = left[g].copy(), int(many[g]), int(first[g])
            else:
                g, rest, at = None, full, used
            copies = int(min(x // y for x, y in zip(rest.tolist(), need.tolist()) if y))
            copies = min(copies, todo)
            take = todo // copies if g is None else min(bins, todo // copies)
            rows.append((length, rank, rank + take * copies, at, copies, int(full[0] - rest[0])))
            if g is None:
                used += take
            else:
                first[g] += take
                many[g] -= take
            add(rest - copies * need, take, at)
            rank, todo = rank + take * copies, todo - take * copies
    return rows


class _WordIds:
    """Token ids of words, kept in the worker; the tokenizer never looks across white space.

    Words of Latin-1 letters, which its normalisation only turns to lower case, are cut
    into parts here, so that a part is merged once whatever stands around it. All
    other words go through the tokenizer whole, and so do texts that hold the string
    of a special token, which the tokenizer finds wherever it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.merge = regex.compile(PARTS).findall, self.tokenizer.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, the others come after
        self.signs = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
        self.part_ids: dict[str, tuple[int, ...]] = {}
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.length = np.zeros(4096, dtype=np.int64), np.zeros(4096, dtype=np.int64)
        self.ids, self.end = np.zeros(65536, dtype=np.uint32), 1  # place 0 is the id 0 that ends documents

    def _encode(self, words: list[str]) -> list[Sequence[int]]:
        if len(self.part_ids) > KEPT_PARTS:
            self.part_ids = {}
        known, one = self.part_ids, self._part
        out: list[Sequence[int]] = []
        other: dict[int, str] = {}
        for w in words:
            if not w.isascii() and max(w) > "\xff":
                other[len(out)] = w
                out.append(())
            elif w.isalpha():
                p = w.lower()
                out.append(known.get(p) or one(p))
            elif w[-1:] in ".,;:!?" and w[:-1].isalpha():
                p, q = w[:-1].lower(), w[-1]
                out.append((known.get(p) or one(p)) + (known.get(q) or one(q)))
            else:
                ids: list[int] = []
                for p in self.parts(w.lower()):
                    ids += known.get(p) or one(p)
                out.append(ids)
        for e, k in zip(self.tokenizer.encode_batch_fast(list(other.values()), add_special_tokens=False), other):
            out[k] = e.ids
        return out

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.part_ids[part] = tuple([t.id for t in self.merge(part.encode().decode("latin-1").translate(self.signs))])
        return ids

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > KEPT_WORDS:
            self._clear()
        index = self.index
        new = [w for w in words if w not in index]
        if new:
            while len(index) + len(new) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            lists = self._encode(new)
            size = np.fromiter(map(len, lists), dtype=np.int64, count=len(new))
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(size.sum()))
            while self.end + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.end : self.end + len(flat)] = flat
            k = len(index)
            self.start[k : k + len(new)] = self.end + np.cumsum(size) - size
            self.length[k : k + len(new)] = size
            index.update(zip(new, range(k, k + len(new))))
            self.end += len(flat)
        at = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        return self.start[at], self.length[at]

    def encode(self, texts: pa.Array, words_at_once: int = 300_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """All ids of the texts, each followed by id 0, a few texts at a time: (first text, ids, offsets).

        Words are looked up for all texts together, ids laid out for about
        ``words_at_once`` words, a text at least.
        """
        whole = np.zeros(len(texts), dtype=bool)
        for content in self.special:
            whole |= np.asarray(pc.match_substring(texts, content))
        at = 0
        for k in np.flatnonzero(whole).tolist() + [len(texts)]:
            if k > at:
                for row, ids, offsets in self._by_word(texts.slice(at, k - at), words_at_once):
                    yield at + row, ids, offsets
            if k < len(texts):
                ids = self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids
                yield k, np.array([*ids, 0], dtype=np.uint32), np.array([0, len(ids) + 1])
            at = k + 1

    def _by_word(self, texts: pa.Array, words_at_once: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        words, at, offsets = split_words(texts)
        start, length = self.lookup(words)
        row = 0
        while row < len(texts):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + words_at_once, side="right")) - 1)
            some, ends = at[offsets[row] : offsets[to]], offsets[row + 1 : to + 1] - offsets[row]
            begin, size = np.insert(start[some], ends, 0), np.insert(length[some], ends, 1)
            after = np.cumsum(size)
            where = np.repeat(begin - (after - size), size) + np.arange(after[-1])
            yield row, self.ids[where], np.concatenate(([0], after[ends + np.arange(to - row)]))
            row = to


_encoders: dict[str, _WordIds] = {}


def _encoder(path: str) -> _WordIds:
    if path not in _encoders:
        _encoders[path] = _WordIds(path)
    return _encoders[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, size: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    Null text counts as empty: a piece that holds id 0 only.
    """

    def pieces(doc_ids: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        n = -(-np.diff(cuts) // size)  # every text has id 0 at least
        row = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = cuts[row] + piece * size
        end = np.minimum(begin + size, cuts[row + 1])
        data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(begin.tolist(), end.tolist())]
        cols = [doc_ids.take(pa.array(row)), pa.array(piece, type=pa.int32()), pa.array(piece * size), pa.array(end - begin), pa.array(crc, type=pa.int64())]
        if with_ids:
            cols.append(pa.array([ids[s:e].astype(np.int32) for s, e in zip(begin, end)], type=pa.list_(pa.int32())))
        return pa.record_batch(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            doc_ids = b.column(0).cast(pa.int64())
            for first, texts in chunks(text_column(b.column(1)), CHUNK):
                for row, ids, cuts in encoder.encode(texts):
                    yield pieces(doc_ids.slice(first + row, len(cuts) - 1), ids, cuts)
        encoder._clear()  # the parts stay for the worker's next task

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), rule: str = "norm", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, each sequence gapless from 0.

    Null text counts as empty, rows without doc_id and repeated rows are packed as
    documents of their own, other columns are ignored, and an empty table gives an
    empty result. Pieces of equal length are interchangeable; which of them goes
    where follows a hash of doc_id and piece. Texts of any length are cut whole. With
    the default capacity a sequence is bound by its tokens alone: documents and
    attention cost can't exceed theirs before; smaller ones bind as well.
    """
    spark = docs.sparkSession
    salts = partitions(spark)
    pieces = materialise(tokenised_pieces(docs, tokenizer, capacity.tokens, with_ids)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = materialise(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), narrow=True)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity.tokens rows at most
    plan = pack_histogram(histogram, capacity, rule=rule)
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)
    span = np.int64(max(histogram.values(), default=0) + 1)

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    # The window needs the pieces dealt by length and salt anyway, so the join is a merge of what is dealt, whatever the size of the bases.
    ranked = pieces.join(bases.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * span + table[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(starts, length * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.record_batch(
                [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)],
                names=[*b.schema.names[:-1], "sequence_id", "offset"],
            )

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*cols).mapInArrow(place, schema)
