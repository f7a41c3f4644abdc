"""Near duplicates of a given Jaccard similarity through deletion-variant signatures of wide fingerprints.

The method of ``simhash``, for texts that are less alike than four bits of 64 allow.
A copy of similarity 0.8 differs in about a bit of seven, so a fingerprint of 306 bits
is cut into 17 segments, each indexed with every single bit left out; copies agree but
for one bit in a segment or more. Rows that meet under a key are sifted by 64 more bits,
then by all bits, and what remains is verified on the whole sets of shingles: no pair
below the similarity is linked, and of those at or above it few are missed (the README
gives the measured share).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shoal.llm._base import materialise, partitions
from shoal.llm._words import chunks, split_words, text_column
from shoal.llm.components import components
from shoal.llm.simhash import MET, block_pairs, key_runs, met_batch, run_edges

SHINGLE, SIMILARITY = 5, 0.8
#: Segments and their bits; how many of the 64 bits beyond them, and of all bits, may differ in two sets that are compared in full. At 0.8 about 10 and 58 do, of unlike sets 32 and 192.
SEGMENTS, WIDTH, MOST, MOST_OF_ALL = 17, 18, 18, 80
WORDS = -(-SEGMENTS * WIDTH // 64) + 1
#: Rows of one key that are compared in one go, and near pairs of a key beyond which a first round takes a spanning star of them.
BLOCK, DENSE = 1024, 3
#: Segments whose keys come first; those of the others then meet with what these have linked.
FIRST = 4

_step = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a shorter text is one shingle, one without words none.

    Case (A-Z) and the amount of ASCII white space don't count.
    """
    for _, part in chunks(text_column(texts)):
        yield from _sets_of(part, width)


def _sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    words, ids, offsets = split_words(pc.ascii_lower(texts))
    hashed = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words], dtype=np.uint64)
    h = hashed[ids] if len(ids) else np.empty(0, dtype=np.uint64)
    factor = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(h) - width + 1)
    rows = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        rows += h[k : k + n] * factor[k]
    rows = _mix(rows)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if 0 < e - s < width:
            yield _mix((h[s:e] * factor[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s))
        else:
            yield np.unique(rows[s : max(s, e - width + 1)])


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set in WORDS words: a bit is set if more than half the shingles' hashes set it."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 8192):
        part = shingles[at : at + 8192]
        bits = np.unpackbits(_mix(part[:, None] + _step).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)


_FP = [f"f{k}" for k in range(WORDS)]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have a few million bytes."""
    for at, part in chunks(text_column(batch.column(column))):
        yield batch.slice(at, len(part))


def _fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), sig (hash of the set), and the fingerprint's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in _parts(whole, 2)):
            sets = list(shingle_sets(b.column(2), width))
            sig = np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.stack([wide_fingerprint(s) for s in sets]).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1), pa.array(sig), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(WORDS))], names=["doc_id", "th", "sig", *_FP])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, sig long, " + ", ".join(f"{c} long" for c in _FP))


def _variants(one: DataFrame, *kept: str, segments: range = range(SEGMENTS)) -> DataFrame:
    """WIDTH rows a segment and set: key = segment, which bit is left out and the rest of the segment; and the columns to be kept."""
    # key: the number of the segment and bit, before the segment's bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, one_out = (1 << np.arange(WIDTH, dtype=np.int32)), np.arange(SEGMENTS * WIDTH, dtype=np.int32).reshape(SEGMENTS, WIDTH) << WIDTH
        for b in batches:
            words = np.stack([b.column(k).to_numpy() for k in range(WORDS - 1)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8 * (WORDS - 1)), axis=1, bitorder="little")
            values = bits[:, : SEGMENTS * WIDTH].reshape(-1, SEGMENTS, WIDTH)[:, segments.start : segments.stop].astype(np.int32) @ power
            keys = (values[:, :, None] & ~power[None, None, :]) | one_out[None, segments.start : segments.stop, :]
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * (len(segments) * WIDTH)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).astype(np.int32)))
            yield pa.record_batch([listed, *(b.column(k) for k in range(WORDS, b.num_columns))], names=["keys", *kept])

    listed = one.select(*_FP, *(F.col(c).alias(f"{c}_") for c in kept)).mapInArrow(run, "keys array<int>" + "".join(f", {c} long" for c in kept))
    return listed.select(F.explode("keys").alias("key"), *kept)


def _near(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all rows of one key whose 64 bits differ in ``most`` or fewer."""
    left, right = [], []
    at, gap = np.arange(len(key)), 1
    while True:
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + gap]) <= most]
        left.append(near)
        right.append(near + gap)
        gap += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _stars(fp: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Fewer near pairs that connect just the places that all near pairs connect.

    The medoid of what is left is tied to all that is near to it, as the text that a
    group was copied from is like more of its copies than these are like each other.
    Each other place keeps one pair with those, and the others go on among themselves.
    """
    apart = np.bitwise_count(fp[:, None] ^ fp[None, :])
    near, live, a, b = apart <= most, np.arange(len(fp)), [], []
    while len(live) > 1:
        inner = near[np.ix_(live, live)]
        live = live[inner.sum(axis=1) > 1]
        if not len(live):
            break
        inner = near[np.ix_(live, live)]
        centre = int(apart[np.ix_(live, live)].sum(axis=1, dtype=np.int64).argmin())
        tied = inner[centre]
        for k in np.flatnonzero(tied).tolist():
            if k != centre:
                a.append(int(live[centre]))
                b.append(int(live[k]))
        others = np.flatnonzero(~tied)
        if len(others):
            bridge = inner[np.ix_(others, np.flatnonzero(tied))]
            has = bridge.any(axis=1)
            a += live[others[has]].tolist()
            b += live[np.flatnonzero(tied)[bridge[has].argmax(axis=1)]].tolist()
        live = live[others]
    return a, b


def _marked(a: np.ndarray, b: np.ndarray, some_left: np.ndarray) -> pa.RecordBatch:
    """Rows of MET; ``number`` is 0 for pairs with an end of which the key holds a near pair that isn't given, else null."""
    batch = met_batch(a, b)
    return batch.set_column(3, "number", pa.array(np.zeros(len(a), dtype=np.int32), mask=~some_left))


def _some_left(n: int, near: tuple[np.ndarray, np.ndarray], given: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each given pair of ``n`` places whether one of its ends has more near pairs than given ones. The near pairs are distinct, the given ones may repeat."""
    a, b = np.asarray(given[0], dtype=np.int64), np.asarray(given[1], dtype=np.int64)
    once = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    ends = lambda x, y: np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
    left = ends(*near) > ends(once // n, once % n)
    return left[a] | left[b]


def _meet(most: int, block: int):
    """First round: near pairs of each key, a spanning star where they are many; blocks of long runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, check, sig), number in key_runs(batches, block):
            if number is not None:
                yield met_batch([], [], [(int(key[0]), number, np.stack([check, sig]).tobytes())])
                continue
            fp, edge = check.view(np.uint64), run_edges(key)
            i, j = _near(key, fp, most)
            of = np.searchsorted(edge, i, side="right") - 1
            many = np.bincount(of, minlength=len(edge)) > DENSE
            few = ~many[of]
            yield met_batch(sig[i[few]], sig[j[few]])
            for k in np.flatnonzero(many).tolist():
                s, e = int(edge[k]), int(edge[k + 1])
                x, y = _stars(fp[s:e], most)
                yield _marked(sig[s:e][x], sig[s:e][y], _some_left(e - s, (i[of == k] - s, j[of == k] - s), (x, y)))

    return run


def _nearest(fp: np.ndarray, comp: np.ndarray, most: int, split: int | None = None, left_out: int | None = None, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each place outside the largest component with the nearest that isn't connected to it, and if ``centred`` with the medoid of the largest, that differ in ``most`` bits or fewer.

    ``fp``: whole fingerprints (words, places). With ``split`` only pairs across that place.
    ``left_out`` is the bit that a whole run's key leaves out. Sets that agree in it, too, meet
    under every bit of the segment: what those give among themselves is given under the
    segment's first bit, and not again under the others.
    """
    n = fp.shape[1]
    apart = np.zeros((n, n), dtype=np.int32)
    for word in fp.view(np.uint64):
        apart += np.bitwise_count(word[:, None] ^ word[None, :])
    whole = apart.copy()
    apart[comp[:, None] == comp[None, :]] = 1 << 20
    if split is not None:
        apart[:split, :split], apart[split:, split:] = 1 << 20, 1 << 20

    def tied(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs among some places."""
        _, of, size = np.unique(comp[at], return_inverse=True, return_counts=True)
        main = of == int(size.argmax())
        i, centre = at[~main], at[main][whole[np.ix_(at[main], at)].sum(axis=1).argmin()]
        j = np.stack([at[apart[np.ix_(i, at)].argmin(axis=1)], np.full(len(i), centre)])
        j = j if centred else j[:1]
        k, near = np.broadcast_to(i, j.shape), apart[i, j] <= most
        return k[near], j[near]

    i, j = tied(np.arange(n))
    if left_out is None:
        return i, j
    bit = (fp[left_out // 64] >> (left_out % 64)) & 1
    agree = [tied(at) for at in (np.flatnonzero(bit == v) for v in (0, 1)) if len(at)]
    x, y = (np.concatenate(c) for c in zip(*agree))
    if left_out % WIDTH == 0:
        return np.concatenate([i, x]), np.concatenate([j, y])
    new = ~np.isin(i * n + j, x * n + y)
    return i[new], j[new]


def _meet_rest(most: int, block: int):
    """The first round's other segments: near pairs of each key that aren't connected yet, where they are many each set with the nearest. Columns: key, the word beyond the segments, sig, comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in key_runs(batches, block):
            if number is not None:
                yield met_batch([], [], [(int(table[0, 0]), number, np.ascontiguousarray(table[1:]).tobytes())])
                continue
            key, fp, sig, comp = table
            edge = run_edges(key)
            i, j = _near(key, fp.view(np.uint64), most)
            apart = comp[i] != comp[j]
            i, j = i[apart], j[apart]
            of = np.searchsorted(edge, i, side="right") - 1
            many = np.bincount(of, minlength=len(edge)) > DENSE
            few = ~many[of]
            a, b, left = [sig[i[few]]], [sig[j[few]]], [np.zeros(int(few.sum()), dtype=bool)]
            for k in np.flatnonzero(many).tolist():
                s, e = int(edge[k]), int(edge[k + 1])
                x, y = _nearest(np.ascontiguousarray(fp[None, s:e]), comp[s:e], most, centred=False)
                a.append(sig[s:e][x])
                b.append(sig[s:e][y])
                left.append(_some_left(e - s, (i[of == k] - s, j[of == k] - s), (x, y)))
            a, b = np.concatenate(a), np.concatenate(b)
            a, b, left = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), np.concatenate(left)]), axis=1)
            yield _marked(a, b, left.astype(bool))

    return run


def _meet_again(most: int, block: int):
    """Later rounds: of each key's run, sets with the nearest that isn't connected to them yet. Columns: key, the fingerprint's words, sig, comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in key_runs(batches, block):
            if number is not None:
                yield met_batch([], [], [(int(table[0, 0]), number, np.ascontiguousarray(table[1:]).tobytes())])
                continue
            edge, sig, comp = run_edges(table[0]), table[-2], table[-1]
            lowest, highest = np.minimum.reduceat(comp, edge[:-1]), np.maximum.reduceat(comp, edge[:-1])
            a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for k in np.flatnonzero(lowest != highest).tolist():
                s, e = int(edge[k]), int(edge[k + 1])
                i, j = _nearest(np.ascontiguousarray(table[1:-2, s:e]), comp[s:e], most, left_out=int(table[0, s]) >> WIDTH)
                a.append(sig[s:e][i])
                b.append(sig[s:e][j])
            a, b = np.concatenate(a), np.concatenate(b)
            yield met_batch(*np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))  # two may be each other's nearest, under several keys

    return run


def _pair_blocks(most: int, of_all: int | None = None, words: int = WORDS):
    """The same for two blocks of a long run: of the first round, or with ``of_all`` bits of ``words`` words of later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            left, right = (np.frombuffer(r[c], dtype=np.int64).reshape(2 if of_all is None else words + 2, -1) for c in ("left", "right"))
            same = r["number"] == r["other"]
            both = left if same else np.concatenate([left, right], axis=1)
            sig = both[1] if of_all is None else both[-2]
            if of_all is not None:
                i, j = _nearest(np.ascontiguousarray(both[:-2]), both[-1], of_all, None if same else left.shape[1])
            else:
                fp, n, m = both[0].view(np.uint64), left.shape[1], 0 if same else left.shape[1]
                near = np.bitwise_count(fp[:n, None] ^ fp[None, m:]) <= most
                i, j = np.nonzero(np.triu(near, 1) if same else near)
                j = j + m
                if len(i) > DENSE:
                    i, j = _stars(fp, most)
            yield pa.record_batch([pa.array(sig[i]), pa.array(sig[j])], names=["a", "b"])

    return run


def _pairs(met: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b."""
    links = met.where(F.col("a").isNotNull()).select("a", "b").unionByName(blocks)
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unsettled(met: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sig) of sets with a near pair that a first round's key has left out; of blocks all, as a block doesn't see the others."""
    links = met.where("a IS NOT NULL AND number IS NOT NULL").select("a", "b").unionByName(blocks)
    return _ends(links.where("a != b"))


def _alike(pairs: DataFrame, one: DataFrame, most: int = MOST_OF_ALL) -> DataFrame:
    """The pairs whose whole fingerprints differ in ``most`` bits or fewer; spares reading the sets of the others."""
    side = lambda end: one.select(F.col("sig").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in _FP))
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _FP), F.lit(0))
    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b"), narrow=True)


def _ends(pairs: DataFrame) -> DataFrame:
    """(sig) of either side, once."""
    side = lambda c: pairs.select(F.col(c).alias("sig")).distinct()  # noqa: E731  a centre of many pairs is one row a task
    return materialise(side("a").unionByName(side("b")).distinct(), narrow=True)


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sig, shingles) of the wanted sets, each from one of its rows; of a shingle's hash 32 bits, which halves what is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in _parts(b, 1)):
            sets = list(shingle_sets(part.column(1), width))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, dtype=np.uint64)]).astype(np.uint32).view(np.int32)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["sig", "shingles"])

    # The least doc_id and hash stand for a set, so that of a hot group of copies one row is read.
    least = rows.join(wanted, "sig").groupBy("sig").agg(F.min("id").alias("id"))
    chosen = materialise(rows.join(least, ["sig", "id"]).groupBy("sig", "id").agg(F.min("th").alias("th")), narrow=True)
    texts = docs.select("id", F.xxhash64("text").alias("th"), "text").join(chosen, ["id", "th"]).dropDuplicates(["sig"]).select("sig", "text")
    return materialise(texts.mapInArrow(run, "sig long, shingles array<int>"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets have the similarity."""
    side = lambda end: sets.select(F.col("sig").alias(end), F.col("shingles").alias(f"of_{end}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialise(met.where(common >= similarity * (F.size("of_a") + F.size("of_b") - common) - 1e-9).select("a", "b"), narrow=True)


def near_components(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST, of_all: int = MOST_OF_ALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, component_id): the least doc_id that chains of near duplicates reach, a row per row.

    Near duplicates are texts whose sets of ``width``-word shingles have a Jaccard
    similarity of ``similarity`` or more; ``th`` is the hash of the row's text (null
    as empty). Equal sets are always linked, texts without words among them, others if
    their fingerprints meet. Texts of any length count whole. Rows without doc_id link
    others and get a component (null if nothing in it has an id); repeated rows share
    theirs. Other columns are ignored; an empty table gives an empty result.

    Where a key holds many near pairs, a first round verifies a spanning star of them,
    not all pairs of the group; it takes FIRST segments, and of the others' near pairs
    those that aren't connected then. Later rounds take the texts of which a key has left out
    a near pair, and those of pairs that all bits leave: each is verified against the nearest
    of each key that isn't connected to it, until a round finds no link. Any other text has
    had all its near pairs compared, by all bits and by sets.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    n = 2 * partitions(docs.sparkSession)
    rows = materialise(_fingerprints(docs, width))
    one = materialise(rows.groupBy("sig").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in _FP)))
    keyed, ends = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))), "a long, b long"
    met = materialise(_variants(one, _FP[-1], "sig", segments=range(FIRST)).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(most, block), MET))
    blocks = materialise(block_pairs(met).mapInArrow(_pair_blocks(most), ends), narrow=True)
    first, unsettled = materialise(_pairs(met, blocks), narrow=True), _unsettled(met, blocks)
    pairs = _alike(first, one, of_all)
    links = _verified(pairs, _sets(docs, keyed, _ends(pairs), width), similarity)
    known = components(links).withColumnRenamed("node", "sig")
    open_ = one.select("sig", *_FP).join(known, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    met = materialise(_variants(open_, _FP[-1], "sig", "component", segments=range(FIRST, SEGMENTS)).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet_rest(most, block), MET))
    blocks = materialise(block_pairs(met).mapInArrow(_pair_blocks(most, most, 1), ends), narrow=True)
    rest = materialise(_pairs(met, blocks).join(first, ["a", "b"], "left_anti"), narrow=True)
    met_pairs, alike = first.unionByName(rest), _alike(rest, one, of_all)
    found = _verified(alike, _sets(docs, keyed, _ends(alike), width), similarity)
    links = materialise(links.unionByName(found), narrow=True)
    known = components(links).withColumnRenamed("node", "sig")
    candidates = materialise(_ends(pairs.unionByName(alike)).unionByName(unsettled).unionByName(_unsettled(met, blocks)).distinct(), narrow=True)
    while not candidates.isEmpty():
        open_ = one.join(candidates, "sig").join(known, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        met = materialise(_variants(open_, *_FP, "sig", "component").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet_again(of_all, block), MET), narrow=True)
        more = _pairs(met, block_pairs(met).mapInArrow(_pair_blocks(most, of_all), "a long, b long"))
        more = materialise(more.join(met_pairs, ["a", "b"], "left_anti"), narrow=True)
        found = _verified(more, _sets(docs, keyed, _ends(more), width), similarity)
        if found.isEmpty():
            break
        links, met_pairs = materialise(links.unionByName(found), narrow=True), materialise(met_pairs.unionByName(more), narrow=True)
        known = components(links).withColumnRenamed("node", "sig")
    linked = one.select("sig", "id").join(known, "sig")
    named = linked.join(linked.groupBy("component").agg(F.min("id").alias("least")), "component").select("sig", "least")
    every = materialise(one.select("sig", "id").join(named, "sig", "left").select("sig", F.coalesce("least", "id").alias("component_id")), narrow=True)
    return rows.join(every, "sig").select("doc_id", "th", "component_id")
