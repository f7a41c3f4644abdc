"""Communities over ties that are never written as rows: lists of members in, packed neighbours in shared files.

Members are dealt to blocks by a hash. A block's file holds the neighbours of its
members, a label file their labels; a round of propagation reads the block's
neighbours and, one after the other, all label files, so nothing is shuffled and no
task holds the whole graph or all labels. Reads grow with blocks times members.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import community
from shoal.operators._lineage import remove, shared_file, shared_path

#: Ends of ties in a block, and those formed at a time.
ENDS, CHUNK = 2_000_000, 2_000_000


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: high bytes are mostly equal."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x, dtype=np.int64)
        raw = x.view(np.uint8).reshape(-1, 8).T.tobytes()
        body = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out.append(np.array([len(x), len(body)], dtype=np.int64).tobytes() + body)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        n, size = np.frombuffer(view[at : at + 16], dtype=np.int64).tolist()
        raw = pa.decompress(view[at + 16 : at + 16 + size], decompressed_size=8 * n, codec="zstd") if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view(np.int64).ravel() if n else np.empty(0, dtype=np.int64))
        at += 16 + size
    return out


def _block(members: np.ndarray, blocks: int) -> np.ndarray:
    x = members.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _write(path: str, *arrays: np.ndarray) -> None:
    with shared_file(path, "wb") as f:
        f.write(_pack(*arrays))


def _read(path: str) -> list[np.ndarray]:
    with shared_file(path, "rb") as f:
        return _unpack(f.read())


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, dtype=np.int64)


def _within(x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in the sorted ``values``, and which are there."""
    if not len(values):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return at, values[at] == x


def _dealt_nodes(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy()
            yield pa.record_batch([pa.array(_block(x, blocks).astype(np.int32)), pa.array(x)], names=["block", "member"])

    return run


def _node_files(folder: str):
    """A file for each block: its members in order, each with itself as label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, member = [], []
        for b in batches:
            block.append(b.column(0).to_numpy())
            member.append(b.column(1).to_numpy())
        if block:
            block, member = np.concatenate(block), np.concatenate(member)
            for k in np.unique(block).tolist():
                own = np.unique(member[block == k])
                _write(path := f"{folder}/{uuid.uuid4().hex}", own, own)
                yield pa.record_batch([pa.array([k], type=pa.int32()), pa.array([path]), pa.array([len(own)], type=pa.int64())], names=["block", "path", "n"])

    return run


def _dealt_lists(blocks: int):
    """Each list goes whole to the blocks of its members; a row a block and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            sizes, flat = np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy()
            if not len(flat):
                continue
            row, offset = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            to = np.unique(_block(flat, blocks) * len(sizes) + row)
            to, row = to // len(sizes), to % len(sizes)
            for s, e in zip(first := _runs(to).tolist(), [*first[1:], len(to)]):
                r = row[s:e]
                n = sizes[r]
                at = np.arange(n.sum()) + np.repeat(offset[r] - np.cumsum(n) + n, n)
                yield pa.record_batch([pa.array([to[s]], type=pa.int32()), pa.array([_pack(n, flat[at])], type=pa.binary())], names=["block", "lists"])

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    if len(keys) > 1:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = _runs(key)
        return [key[first]], [np.add.reduceat(count, first) if len(first) else count]
    return keys, counts


def _neighbours(folder: str, blocks: int, nodes: dict[int, str]):
    """A file for each block: members, how many neighbours each has, the neighbours (by place among the names) and weights, names by block, names of each block."""

    def build(block: int, packs: list[bytes]) -> tuple[str, int] | None:
        if block not in nodes:
            return None
        own = _read(nodes[block])[0]
        lists, inside = [], []
        for p in packs:
            sizes, flat = _unpack(p)
            mine = _within(flat, own)[1]
            row = np.repeat(np.arange(len(sizes)), sizes)
            some = np.bincount(row[mine], minlength=len(sizes)) > 0
            keep = some[row]
            lists.append((sizes[some], flat[keep]))
            inside.append(mine[keep])
        packs.clear()
        sizes, flat, mine = np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists]), np.concatenate(inside)
        del lists, inside
        names, code = np.unique(flat, return_inverse=True)
        there, of = np.zeros(len(names), dtype=bool), _block(names, blocks)
        for k in np.unique(of).tolist():
            if k in nodes:
                there[of == k] = _within(names[of == k], _read(nodes[k])[0])[1]
        keep = there[code]  # members that aren't nodes go
        row = np.repeat(np.arange(len(sizes)), sizes)[keep]
        sizes, code, mine = np.bincount(row, minlength=len(sizes)), code[keep], mine[keep]
        end = np.cumsum(sizes)[row]
        at = np.flatnonzero(mine)
        size = sizes[row[at]]
        total, keys, counts, held, s = np.cumsum(size), [], [], 0, 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + CHUNK, side="right")))
            n = size[s:e]
            other = code[np.arange(n.sum()) + np.repeat(end[at[s:e]] - np.cumsum(n), n)]
            key = np.repeat(code[at[s:e]], n) * len(names) + other
            key = np.sort(key[np.repeat(code[at[s:e]], n) != other])
            first = _runs(key)
            keys.append(key[first])
            counts.append(np.diff(np.append(first, len(key))))
            held, s = held + len(first), e
            if held > 2 * max(CHUNK, len(keys[0])):
                keys, counts = _summed(keys, counts)
                held = len(keys[0])
        keys, counts = _summed(keys, counts)
        if not keys or not len(keys[0]):
            return None
        member, other = keys[0] // len(names), keys[0] % len(names)
        used = np.unique(other)
        order = np.lexsort((names[used], of[used]))
        place = np.zeros(len(names), dtype=np.int64)
        place[used[order]] = np.arange(len(used))
        first = _runs(member)
        parts = np.bincount(of[used], minlength=blocks)
        _write(path := f"{folder}/{uuid.uuid4().hex}", names[member[first]], np.diff(np.append(first, len(member))), place[other], counts[0], np.diff(names[used[order]], prepend=0), parts)
        return path, len(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[bytes]] = {}
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1)):
                packs.setdefault(k, []).append(p.as_py())
        for k in list(packs):
            if done := build(k, packs.pop(k)):
                yield pa.record_batch([pa.array([k], type=pa.int32()), pa.array([done[0]]), pa.array([done[1]], type=pa.int64())], names=["block", "path", "n"])

    return run


def _round(folder: str, found: list[tuple[int, str]], labels: dict[int, str]):
    """Each member takes the heaviest label around it, the least on ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                block, path = found[i]
                member, sizes, other, weight, names, parts = _read(path)
                names, ends = np.cumsum(names), np.cumsum(parts)
                near = np.empty(len(names), dtype=np.int64)
                for k in np.flatnonzero(parts).tolist():
                    of = slice(int(ends[k] - parts[k]), int(ends[k]))
                    accounts, clusters = _read(labels[k])
                    near[of] = clusters[np.searchsorted(accounts, names[of])]
                values, near = np.unique(near, return_inverse=True)
                key = np.repeat(np.arange(len(member)), sizes) * len(values) + near[other]
                order = np.argsort(key, kind="stable")
                key, weight = key[order], weight[order]
                first = _runs(key)
                key, weight = key[first], np.add.reduceat(weight, first)
                who = key // len(values)
                start = _runs(who)
                most = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, start), np.diff(np.append(start, len(who)))))
                best = most[_runs(who[most])]
                _write(out := f"{folder}/{uuid.uuid4().hex}", member, values[key[best] % len(values)])
                yield pa.record_batch([pa.array([block], type=pa.int32()), pa.array([out])], names=["block", "path"])

    return run


def _edges(found: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                member, sizes, other, weight, names, _ = _read(found[i][1])
                src, dst = np.repeat(member, sizes), np.cumsum(names)[other]
                once = src < dst
                yield from pa.Table.from_arrays([pa.array(src[once]), pa.array(dst[once]), pa.array(weight[once])], names=["src", "dst", "weight"]).to_batches(max_chunksize=200_000)

    return run


def _labels(files: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from pa.Table.from_arrays([pa.array(x) for x in _read(files[i])], names=["account", "cluster"]).to_batches(max_chunksize=200_000)

    return run


def _each(spark: SparkSession, n: int) -> DataFrame:
    """A task for each of n files."""
    return spark.range(0, n, 1, n)


def communities(lists: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """(account, cluster): what ``community.partition`` gives for the ties of members that share lists.

    ``lists`` has one column of arrays of integers without repeats; only the integers of
    ``nodes`` (one column) count. A tie weighs a list that both are in. Up to MAX_EDGES
    ties go to Louvain, more to label propagation, as there; members without ties are left out.
    """
    spark, folder = lists.sparkSession, shared_path(lists.sparkSession)
    lists = lists.select(F.col(lists.columns[0]).cast("array<long>").alias("members")).where(F.size("members") > 1)
    nodes = nodes.select(F.col(nodes.columns[0]).cast("long").alias("member")).where("member IS NOT NULL")
    n = F.size("members").cast("double")
    ends = lists.agg(F.sum(n * (n - 1))).first()[0] or 0
    blocks = int(max(2 * spark.sparkContext.defaultParallelism, -(-ends // ENDS)))
    paths = lambda df: {r["block"]: r["path"] for r in df.collect()}  # noqa: E731  a row a block
    labels = paths(nodes.mapInArrow(_dealt_nodes(blocks), "block int, member long").repartition(blocks, "block").mapInArrow(_node_files(f"{folder}/nodes"), "block int, path string, n long"))
    dealt = lists.mapInArrow(_dealt_lists(blocks), "block int, lists binary").repartition(blocks, "block")
    rows = dealt.mapInArrow(_neighbours(f"{folder}/ties", blocks, labels), "block int, path string, n long").collect()
    found = sorted((r["block"], r["path"]) for r in rows)
    if sum(r["n"] for r in rows) <= 2 * community.MAX_EDGES:
        ties = _each(spark, len(found)).mapInArrow(_edges(found), "src long, dst long, weight long") if found else spark.createDataFrame([], "src long, dst long, weight long")
        return community.partition(ties)
    before = f"{folder}/nodes"
    for i in range(rounds):
        labels = paths(_each(spark, len(found)).mapInArrow(_round(f"{folder}/{i}", found, labels), "block int, path string"))
        remove(before)
        before = f"{folder}/{i}"
    remove(f"{folder}/ties")
    return _each(spark, len(labels)).mapInArrow(_labels(list(labels.values())), "account long, cluster long")
