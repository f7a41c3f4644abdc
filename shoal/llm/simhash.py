"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints with at most four differing bits differ, cut into three
segments, by at most one bit in one of them. So each distinct fingerprint is
indexed under every segment with each single bit left out; equal keys meet by
sorting, and every meeting is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._base import materialise, partitions
from shoal.llm._words import text_column
from shoal.llm.components import components

SEED, SHINGLE, MAX_BITS = 42, 4, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of one key that are compared in one go; larger runs are cut into blocks, which are paired.
BLOCK = 4096


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: a bit is set if more than half the shingle hashes set it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in text_column(b.column(1))], dtype=np.uint64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """64 rows a fingerprint: key = which bit is left out, and the rest of its segment."""
    keys = []
    for start, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append(F.lit((start + bit) << 32).bitwiseOR(segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _first_key(x: np.ndarray) -> np.ndarray:
    """For xor values: the bit left out by the first key at which both meet; 64 if none."""
    out = np.full(x.shape, 64, dtype=np.int64)
    for start, width in reversed(SEGMENTS):
        part = (x >> np.uint64(start)) & np.uint64((1 << width) - 1)
        n = np.bitwise_count(part)
        one = start + np.bitwise_count(part - np.uint64(1)).astype(np.int64)
        out = np.where(n == 0, start, np.where(n == 1, one, out))
    return out


class _Forest:
    """Union-find over a few thousand positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _links(fa: np.ndarray, fb: np.ndarray, same: bool, bit: int, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of one key (or within one).

    Only links whose first common key this is are looked at; the others are found
    there. All of them are verified; those that close a circle are left out, so
    that a dense group gives no more links than it has members.
    """
    n, forest, out = len(fa), _Forest(len(fa) + (0 if same else len(fb))), []
    left, right = fa.view(np.int64), fb.view(np.int64)
    step = max(1, 2_000_000 // max(1, len(fb)))
    for at in range(0, n, step):
        x = fa[at : at + step, None] ^ fb[None, :]
        near = np.bitwise_count(x) <= most
        if same:
            near &= np.arange(at, min(n, at + step))[:, None] < np.arange(len(fb))[None, :]
        i, j = np.nonzero(near)
        if len(i):
            first = _first_key(x[i, j]) == bit
            for a, b in zip((i[first] + at).tolist(), j[first].tolist()):
                if forest.join(a, b if same else n + b):
                    out.append((int(left[a]), int(right[b])))
    return out


def run_edges(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))


def key_runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[np.ndarray, int | None]]:
    """The rows (key, ...) of a sorted partition as columns: (whole runs of at most ``block`` rows, None) or (a block of a larger run, its number).

    At most a batch and a block are held, however long a run is.
    """

    def whole(table: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
        edge = run_edges(table[0])
        size = np.diff(edge)
        for s, n in zip(edge[:-1][size > block].tolist(), size[size > block].tolist()):
            yield from ((table[:, i : min(i + block, s + n)], k) for k, i in enumerate(range(s, s + n, block)))
        small = np.repeat(size <= block, size)
        if small.any():
            yield table[:, small], None

    rest, number, key = None, 0, 0  # rows not given yet; blocks given of the run they begin with, and its key
    for b in batches:
        if not b.num_rows:
            continue
        part = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(b.num_columns)])
        table = part if rest is None else np.concatenate([rest, part], axis=1)
        if number:
            end, at = int(np.searchsorted(table[0], key, side="right")), 0
            while end - at >= block:
                yield table[:, at : at + block], number
                at, number = at + block, number + 1
            if end == table.shape[1]:
                rest = table[:, at:]
                continue
            if end > at:
                yield table[:, at:end], number
            table, number = table[:, end:], 0
        cut = int(np.searchsorted(table[0], table[0, -1], side="left"))
        if cut:
            yield from whole(table[:, :cut])
        rest = table[:, cut:]
        while rest.shape[1] > block:
            key = int(rest[0, 0])
            yield rest[:, :block], number
            rest, number = rest[:, block:], number + 1
    if rest is not None and rest.shape[1]:
        if number:
            yield rest, number
        else:
            yield from whole(rest)


#: A link (a, b), or a block of a key's run that is too long for one go.
MET = "a long, b long, key long, number int, block binary"


def met_batch(a, b, blocks: list[tuple[int, int, bytes]] = ()) -> pa.RecordBatch:
    """Rows of MET."""
    n, m = len(a), len(blocks)
    cols = [np.concatenate([np.asarray(x, dtype=np.int64), np.zeros(m, dtype=np.int64)]) for x in (a, b)]
    gap = np.arange(n + m) >= n
    late = lambda k, t: pa.array([None] * n + [x[k] for x in blocks], type=t)
    return pa.record_batch([*(pa.array(c, mask=gap) for c in cols), late(0, pa.int64()), late(1, pa.int32()), late(2, pa.binary())], names=["a", "b", "key", "number", "block"])


def block_pairs(met: DataFrame) -> DataFrame:
    """(key, number, other, left, right): each pair of blocks of a run, a block with itself included.

    The pairs are dealt by key and block, so a single long run is work for many tasks.
    """
    blocks = met.where(F.col("block").isNotNull()).select("key", "number", "block")
    tops = blocks.groupBy("key").agg(F.max("number").alias("top"))
    pairs = blocks.select("key", "number").join(tops, "key").select("key", "number", F.explode(F.sequence("number", "top")).alias("other"))
    named = lambda at, name: blocks.select("key", F.col("number").alias(at), F.col("block").alias(name))
    return pairs.join(named("number", "left"), ["key", "number"]).join(named("other", "right"), ["key", "other"]).select("key", "number", "other", "left", "right")


def _meet(most: int, block: int):
    """Links of each key's run in a sorted partition, and the blocks of large runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, node), number in key_runs(batches, block):
            if number is not None:
                yield met_batch([], [], [(int(key[0]), number, node.tobytes())])
                continue
            fp, edge = node.view(np.uint64), run_edges(key)
            size = np.diff(edge)
            two = edge[:-1][size == 2]  # by far the most
            x = fp[two] ^ fp[two + 1]
            ok = (np.bitwise_count(x) <= most) & (_first_key(x) == key[two] >> 32)
            yield met_batch(node[two[ok]], node[two[ok] + 1])
            links: list[tuple[int, int]] = []
            for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
                links += _links(fp[s : s + n], fp[s : s + n], True, int(key[s] >> 32), most)
            for i in range(0, len(links), 50_000):
                yield met_batch(*zip(*links[i : i + 50_000]))

    return run


def _pair_blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fa, fb = (np.frombuffer(r[c], dtype=np.uint64) for c in ("left", "right"))
                links = _links(fa, fb, r["number"] == r["other"], r["key"] >> 32, most)
                yield pa.record_batch([pa.array([x[i] for x in links], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def simhash_links(fps: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect just the fingerprints that chains of links connect.

    ``fps``: distinct fp, each a node of its own. No chain is lost: of each key's
    links a spanning forest is kept.
    """
    n = 2 * partitions(fps.sparkSession)
    met = materialise(_variants(fps).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(most, block), MET))
    links = met.where(F.col("a").isNotNull()).select("a", "b")
    return links.unionByName(block_pairs(met).mapInArrow(_pair_blocks(most), "a long, b long"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``.

    Null and empty texts, and texts of white space, have fingerprint zero and are
    linked like any other; a text of any length is hashed whole, 65536 shingles at a
    time. Rows without doc_id link others and get the component they lie in; it is
    null if nothing in it has an id. Repeated rows are linked by their equal
    fingerprints. Other columns are ignored; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), narrow=True)
    comp = components(simhash_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    # Components are worked out over fingerprints and named afterwards, so that a row without an id can't name one.
    linked = distinct.join(comp, "fp")
    named = linked.join(linked.groupBy("component").agg(F.min("id").alias("least")), "component").select("fp", "least")
    every = materialise(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id")), narrow=True)  # read plainly below, so that a hot fingerprint's join can be split
    return fps.join(every, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
