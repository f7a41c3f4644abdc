"""Line dedup by pairwise alignment.

Documents meet through rare hashes of lines: those of windows, line ranges with 30
words and none to spare at one end. A single line may be on every page; a window is
as rare as the passages that repeat. Each later holder of a window is paired with its
first holder, which is enough, as all holders have the same lines there. Each pair is
aligned by patience diff, and the aligned blocks of 30 words or more, line for line
in both, go from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._base import fresh, materialise
from shoal.llm._words import text_column

#: A block is deleted if it has so many words; shorter overlaps are chance or boilerplate.
MIN_WORDS = 30


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Line ranges (first, last) that have ``min_words`` and none to spare at one end.

    A run of lines has so many words just if such ranges lie in it, and then they cover it.
    """
    out, first, have = set(), 0, 0
    for last, n in enumerate(words):
        have += n
        while have - words[first] >= min_words:
            have -= words[first]
            first += 1
        if have >= min_words:
            out.add((first, last))  # the shortest that ends here
    last, have = len(words) - 1, 0
    for first in range(len(words) - 1, -1, -1):
        have += words[first]
        while have - words[last] >= min_words:
            have -= words[last]
            last -= 1
        if have >= min_words:
            out.add((first, last))  # the shortest that begins here
    return sorted(out)


def window_hashes(lines: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(first, last, hash of the lines' sequence) of each window."""
    from xxhash import xxh64_intdigest

    data = b"".join(h.to_bytes(8, "little", signed=True) for h in lines)
    return [(first, last, _signed(xxh64_intdigest(data[8 * first : 8 * last + 8]))) for first, last in windows(words, min_words)]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_index(docs: DataFrame, min_words: int) -> DataFrame:
    """Documents that have windows: doc_id, th (text hash), lines (hashes), words, at (their places in the text), windows.

    White space within and around a line doesn't count, nor do blank lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        window = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("h", pa.int64())])
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(window)]
        for b in batches:
            ids, hashes = b.column(0).cast(pa.int64()).to_pylist(), b.column(2).to_pylist()
            rows: list[tuple] = []
            for doc_id, th, text in zip(ids, hashes, text_column(b.column(1))):
                split = [(at, parts) for at, line in enumerate(text.as_py().encode("utf-8", "surrogatepass").split(b"\n")) if (parts := line.split())]
                words = [len(parts) for _, parts in split]
                if sum(words) >= min_words:
                    lines = [_signed(xxh64_intdigest(b" ".join(parts))) for _, parts in split]
                    rows.append((doc_id, th, lines, words, [at for at, _ in split], [dict(zip(("first", "last", "h"), w)) for w in window_hashes(lines, words, min_words)]))
                if len(rows) >= 500:
                    yield pa.record_batch([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=_INDEX)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=_INDEX)

    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return keyed.mapInArrow(run, "doc_id long, th long, lines array<long>, words array<int>, at array<int>, windows array<struct<first:int,last:int,h:long>>")


_INDEX = ["doc_id", "th", "lines", "words", "at", "windows"]


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest increasing run of (left, right) positions, each position at most once."""
    tops: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    top_nodes: list[int] = []
    for left, right in sorted(pairs):
        k = bisect_left(tops, right)
        nodes.append((left, right, top_nodes[k - 1] if k else -1))
        if k == len(tops):
            tops.append(right)
            top_nodes.append(len(nodes) - 1)
        else:
            tops[k], top_nodes[k] = right, len(nodes) - 1
    out, at = [], top_nodes[-1] if top_nodes else -1
    while at >= 0:
        left, right, at = nodes[at]
        out.append((left, right))
    return out[::-1]


def patience_diff(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Aligned places: equal lines at the ends of a range, those that are unique in both ranges in a longest increasing run, and so on between them."""
    out, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_left, in_right = Counter(left[a:b]), Counter(right[c:d])
        where = {right[j]: j for j in range(c, d) if in_right[right[j]] == 1}
        anchors = patience([(i, where[left[i]]) for i in range(a, b) if in_left[left[i]] == 1 and left[i] in where])
        out += anchors
        if anchors:
            for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def common_blocks(left: list[int], words: list[int], right: list[int], right_words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Places (first, last) of ``left`` whose lines stand together in ``right``, in blocks of ``min_words`` or more.

    The alignment keeps one order, so blocks that stand in another order, or whose
    lines repeat, may be left over; they are taken window by window.
    """
    blocks, begin = [], 0
    aligned = patience_diff(left, right)
    for k in range(1, len(aligned) + 1):
        if k == len(aligned) or aligned[k] != (aligned[k - 1][0] + 1, aligned[k - 1][1] + 1):
            first, last = aligned[begin][0], aligned[k - 1][0]
            if sum(words[first : last + 1]) >= min_words:
                blocks.append((first, last))
            begin = k
    there = {h for *_, h in window_hashes(right, right_words, min_words)}
    starts = [first for first, _ in blocks]
    moved = []
    for first, last, h in window_hashes(left, words, min_words):
        k = bisect_left(starts, first + 1) - 1
        if h in there and (k < 0 or blocks[k][1] < last):
            moved.append((first, last))
    return blocks + moved


def merged(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Line ranges (first, last), overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(blocks):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def line_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, blocks, partners) of each document that repeats an earlier one's lines."""
    index = materialise(line_index(docs, min_words))
    met = index.select("doc_id", "th", F.explode("windows").alias("w")).select("doc_id", "th", "w.first", "w.last", "w.h")
    place = F.struct("doc_id", "th", "first", "last")
    holders = met.groupBy("h").agg(F.min(place).alias("f"), F.max(F.struct("doc_id", "th")).alias("l"))
    # Written, so that the join below reads it plainly: broadcast while it is small, else split where a window is on many pages.
    first = materialise(
        holders.where("struct(f.doc_id, f.th) < l").select("h", F.col("f.doc_id").alias("p_doc"), F.col("f.th").alias("p_th"), F.col("f.first").alias("p_first"), F.col("f.last").alias("p_last")), narrow=True
    )
    later = met.join(first, "h").where("struct(doc_id, th) > struct(p_doc, p_th)")
    # What lies between the first and the last window of a pair is all that has to be aligned.
    pairs = materialise(
        later.groupBy("doc_id", "th", "p_doc", "p_th").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("p_first").alias("p_first"), F.max("p_last").alias("p_last")), narrow=True
    )
    part = lambda c, a, b: F.slice(c, F.col(a) + 1, F.col(b) - F.col(a) + 1)
    needed = pairs.select("doc_id", "th").unionByName(pairs.select(F.col("p_doc").alias("doc_id"), F.col("p_th").alias("th"))).distinct()
    index = materialise(index.drop("windows").join(materialise(needed, narrow=True), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]))  # repeated rows once
    left = pairs.join(index, ["doc_id", "th"]).select("doc_id", "th", "p_doc", "p_th", "p_first", "p_last", *(part(c, "first", "last").alias(c) for c in ("lines", "words", "at")))
    right = index.select(F.col("doc_id").alias("p_doc"), F.col("th").alias("p_th"), F.col("lines").alias("r_lines"), F.col("words").alias("r_words"))
    both = left.join(right, ["p_doc", "p_th"]).select("doc_id", "th", "p_doc", "lines", "words", "at", *(part(c, "p_first", "p_last").alias(c) for c in ("r_lines", "r_words")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cols = [c.to_pylist() for c in b.columns[:3]], [[], [], []]
            for k in range(b.num_rows):
                lines, words, at, r_lines, r_words = (b.column(c)[k].as_py() for c in range(3, 8))
                for first, last in merged(common_blocks(lines, words, r_lines, r_words, min_words)):
                    for col, x in zip(cols, (k, at[first], at[last])):
                        col.append(x)
            if cols[0]:
                yield pa.record_batch([*(pa.array([c[k] for k in cols[0]], type=pa.int64()) for c in ids), *(pa.array(c, type=pa.int32()) for c in cols[1:])], names=["doc_id", "th", "p_doc", "first", "last"])

    aligned = both.mapInArrow(align, "doc_id long, th long, p_doc long, first int, last int")
    # A group is one document's blocks.
    by_doc = aligned.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("found"), F.array_sort(F.collect_set("p_doc")).alias("partners"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for b in batches:
            blocks = [[{"first": s, "last": e} for s, e in merged([(r["first"], r["last"]) for r in rows])] for rows in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(blocks, type=blocks_type), b.column(3)], names=["doc_id", "th", "blocks", "partners"])

    return by_doc.mapInArrow(join, "doc_id long, th long, blocks array<struct<first:int,last:int>>, partners array<long>")


def edit_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "shoal_removed", partners: str = "shoal_partners") -> DataFrame:
    """``docs`` with repeated blocks gone from ``text``, and two columns: how many lines went, and whose they repeat.

    A document is later than another by its doc_id (for one doc_id: by a hash of its
    text). Rows repeating doc_id and text are one document and get the same edit. A
    null text stays null and an empty one empty; rows without doc_id are left as they
    are. A document that is repeated wholly becomes empty; texts of any length are
    read whole. ``docs`` may have any columns but those that are added (ValueError).
    An empty table gives an empty result.
    """
    if {removed, partners} & set(docs.columns):
        raise ValueError(f"columns {removed} and {partners} are added; name others")
    row, th, blocks = fresh(docs, "shoal_id", "shoal_th", "shoal_blocks")
    found = line_blocks(docs, min_words).select(F.col("doc_id").alias(row), F.col("th").alias(th), F.col("blocks").alias(blocks), F.col("partners").alias(partners))
    on = (docs["doc_id"] == F.col(row)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(th))
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.exists(blocks, lambda b: i.between(b["first"], b["last"]))), "\n")
    gone = F.aggregate(blocks, F.lit(0), lambda n, b: n + b["last"] - b["first"] + 1)
    return (
        docs.join(found, on, "left")
        .withColumn("text", F.when(F.col(blocks).isNull(), F.col("text")).otherwise(rest))
        .withColumn(removed, F.coalesce(gone, F.lit(0)))
        .withColumn(partners, F.coalesce(partners, F.array().cast("array<long>")))
        .drop(row, th, blocks)
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, removed_lines, partners: a row per row, by ``edit_lines``; other columns are ignored."""
    return edit_lines(docs.select("doc_id", "text"), min_words, "removed_lines", "partners")
