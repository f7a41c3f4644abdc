"""Column-wise word handling for Arrow batches.

A batch of texts becomes one array of word numbers. Whatever a model needs of a
word is worked out once per distinct word and kept in the Python worker; the
documents are then summed up with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_column(col: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each occurrence's number among them, and each text's offsets.

    Words are runs without ASCII white space.
    """
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    offsets = words.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    # No word holds a line feed, so the distinct ones come over as one string.
    listed = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
    distinct = pc.binary_join(listed, "\n")[0].as_py().split("\n") if len(coded.dictionary) else []
    at = coded.indices.to_numpy(zero_copy_only=False)
    if "" in distinct:  # the split gives it around white space at the ends of a text
        keep = at != distinct.index("")
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        at = at[keep]
    return distinct, at, offsets


def chunks(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``size`` bytes, a text at least: (first row, texts)."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield at, texts.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return what was freed to the system; a worker lives on and would keep the most it ever had."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class WordTable:
    """Rows of numbers per word, computed once per worker.

    ``make`` gives the row of a word, or with ``many`` the rows of a list of words. At
    ``limit`` words the table starts anew, so memory is bounded however many words the
    corpus has.
    """

    def __init__(self, make: Callable, width: int, limit: int = 600_000, many: bool = False):
        self.make, self.width, self.limit, self.many = make, width, limit, many
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, self.width), dtype=np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Table rows of the words, as an array (len(words), width)."""
        if len(self.index) > self.limit:
            self._clear()
        index, make = self.index, self.make
        need = len(index) + len(words)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.width), dtype=np.float32)
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        rows, at = self.rows, np.empty(len(words), dtype=np.int64)
        if self.many:
            first, new = len(index), [w for w in words if w not in index]
            if new:
                index.update(zip(new, range(first, first + len(new))))
                rows[first : len(index)] = make(new)
            return rows[np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))]
        for k, word in enumerate(words):
            i = index.get(word)
            if i is None:
                i = index[word] = len(index)
                rows[i] = make(word)
            at[k] = i
        return rows[at]
