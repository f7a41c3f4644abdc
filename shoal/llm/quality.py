"""Quality by Bradley-Terry ranking: logistic loss on feature differences of preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._base import distinct_texts, held_out, materialise
from shoal.llm._words import WordTable, chunks, split_words, sums, text_column

#: Texts of the rarer label that are compared with all of a bucket's others, texts of a package, bins of a pass over the scores, score at the threshold.
RARER, PACKAGE, BINS, CUT = 32, 4096, 4096, 0.3
DECAY = 1e-3


def _shape(word: str) -> tuple:
    """What the features need of a word."""
    letters = sum(map(str.isalpha, word))
    upper = sum(map(str.isupper, word))
    digits = sum(map(str.isdigit, word))
    symbols = sum(c in "*#$%&@|~^<>{}[]\\=+_" for c in word)
    stops = sum(c in ".,;:!?" for c in word)
    return (1, len(word), letters, upper, digits, symbols, stops, letters > 1 and upper == letters, symbols > 0, letters == 0)


def feature_matrix(texts: pa.Array, table: WordTable) -> np.ndarray:
    """A row of features per text; texts without a word have zeros but for the bias of length."""
    words, at, offsets = split_words(texts)
    total = sums(table.lookup(words)[at], offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    distinct = np.bincount(np.unique(row * max(1, len(words)) + at) // max(1, len(words)), minlength=len(texts))
    again = np.zeros(len(texts))
    if len(at) > 1:
        again += np.bincount(row[1:], weights=(at[1:] == at[:-1]) & (row[1:] == row[:-1]), minlength=len(texts))
    n, chars = np.maximum(total[:, 0], 1), np.maximum(total[:, 1], 1)
    rates = np.stack([total[:, 5] / chars, total[:, 3] / np.maximum(total[:, 2], 1), total[:, 4] / chars, total[:, 6] / chars, *(total[:, k] / n for k in (7, 8, 9)), again / n], axis=1)
    variety = np.log1p(distinct) / np.log1p(n)
    return np.concatenate([rates, np.tanh(20 * rates), np.stack([distinct / n, variety, np.minimum(variety, 0.9), np.log1p(total[:, 0]) / 10, chars / n / 10, np.tanh(np.abs(chars / n - 5) / 5)], axis=1)], axis=1)


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0 to 1 and in the order of the ranking; the quantile threshold lies at CUT."""
        raw = (x - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + np.log(CUT / (1 - CUT)), -40, 40)))


#: From a function of a package (features of good and of bad texts) the sum of its arrays over all packages.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _moments(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """How many texts are good and bad, and the sums of their features."""
    both = np.concatenate([good, bad])
    return np.concatenate([[len(good), len(bad)], both.sum(axis=0)])


def _loss(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Pairs, logistic loss of their differences, its gradient and its curvature, over all pairs of a package."""

    def run(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        d, out = len(w), np.zeros(2 + len(w) + len(w) ** 2)
        g, b = (good - mean) / scale, (bad - mean) / scale
        for row in g if len(g) <= len(b) else b:
            diff = row - b if len(g) <= len(b) else g - row
            m = np.clip(diff @ w, -40, 40)
            p = 1 / (1 + np.exp(m))
            out[0] += len(m)
            out[1] += np.logaddexp(0, -m).sum()
            out[2 : 2 + d] -= diff.T @ p
            out[2 + d :] += ((diff * (p * (1 - p))[:, None]).T @ diff).reshape(-1)
        return out

    return run


def _at_ranks(total: Total, scores: Callable, kinds: list[str], ranks: list[float], low: float, high: float) -> list[float]:
    """The scores of those ranks among all ('all') or the 'good' or 'bad' texts: bins over bins, until they are as fine as the numbers."""
    bounds = [(low, high)] * len(ranks)
    for _ in range(4):
        now = list(bounds)

        def count(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
            g, b, out = scores(good), scores(bad), []
            for kind, (x, y) in zip(kinds, now):
                v = g if kind == "good" else b if kind == "bad" else np.concatenate([g, b])
                at = np.clip(np.floor((v - x) / max(y - x, 1e-300) * BINS), -1, BINS).astype(np.int64) + 1
                out.append(np.bincount(at, minlength=BINS + 2))
            return np.stack(out).astype(float)

        for k, n in enumerate(total(count)):
            x, y = now[k]
            at = int(np.searchsorted(np.cumsum(n), ranks[k], side="right"))
            at = min(max(at - 1, 0), BINS - 1)
            bounds[k] = (x + (y - x) * at / BINS, x + (y - x) * (at + 1) / BINS)
    return [(x + y) / 2 for x, y in bounds]


def fit(total: Total, width: int, steps: int = 30) -> RankModel:
    """Learn from pairs of a good and a bad document, all packages' whole; without both kinds all score alike.

    Newton's method on the mean logistic loss, ridged. The threshold is the quantile of
    all scores at the share of bad documents.
    """
    first = total(_moments)
    n_good, n_bad = int(first[0]), int(first[1])
    n = n_good + n_bad
    mean = first[2:] / max(n, 1)
    scale = np.sqrt(total(lambda g, b: ((np.concatenate([g, b]) - mean) ** 2).sum(axis=0)) / n) + 1e-6 if n else np.ones(width)
    w = np.zeros(width)
    if not n_good or not n_bad:
        return RankModel(mean, scale, w, 0.0 if n_bad == 0 else 1.0, 1.0)
    step, best, at = np.zeros(width), np.inf, w
    for _ in range(steps):
        s = total(_loss(w, mean, scale))
        loss = s[1] / s[0] + DECAY * w @ w / 2
        if loss > best:  # too far: halve the step
            step = step / 2
            if np.abs(step).max() < 1e-6:
                break
            w = at + step
            continue
        grad = s[2 : 2 + width] / s[0] + DECAY * w
        step = -np.linalg.solve(s[2 + width :].reshape(width, width) / s[0] + DECAY * np.eye(width), grad)
        at, best = w, loss
        if np.abs(step).max() < 1e-6:
            break
        w = at + step
    w = at
    scores = lambda x: (x - mean) / scale @ w
    reach = lambda g, b: np.concatenate([scores(g), scores(b)])
    span = 1 + float(total(lambda g, b: np.abs(reach(g, b)).sum(keepdims=True))[0])
    level = n_bad / n
    ranks = [max(0.0, level - 0.005) * (n - 1), min(1.0, level + 0.005) * (n - 1), (n_good - 1) / 2, (n_bad - 1) / 2]
    least, most, good, bad = _at_ranks(total, scores, ["all", "all", "good", "bad"], ranks, -span, span)
    return RankModel(mean, scale, w, (least + most) / 2, float(2.0 / (good - bad + 1e-6) * 3))  # in the middle of the gap, if there is one


def _packages(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Good and bad texts of one bucket in bounded packages, each text in just one, the rarer label spread over all."""
    good, bad = x[y == 1], x[y == 0]
    parts = max(1, min(-(-len(x) // PACKAGE), min(len(good), len(bad))))
    for k in range(parts):
        yield good[k::parts], bad[k::parts]


def fit_pairs(x: np.ndarray, y: np.ndarray) -> RankModel:
    """``fit`` of features at hand."""
    parts = list(_packages(x, y))
    return fit(lambda f: np.sum([f(g, b) for g, b in parts], axis=0), x.shape[1])


def train_quality(docs: DataFrame, labels: DataFrame) -> RankModel:
    """Learn from all labelled documents whose fold isn't held out; equal texts count once.

    Features are written once, in buckets that hold some RARER texts of the rarer label:
    each good text is compared with each bad one of its package. Each step is a pass over
    the packages; only sums reach the driver.
    """
    chosen = distinct_texts(docs, labels, "quality").where(F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    buckets = max(1, min(counts.get(0, 0), counts.get(1, 0)) // RARER)
    wanted = chosen.select("doc_id", "y", F.pmod("h", F.lit(buckets)).alias("bucket"), F.col("h").alias("order"))
    width = feature_matrix(pa.array([""]), WordTable(_shape, 10)).shape[1]
    # A repeated doc_id may have other texts: the one with the hash is meant.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("order", F.xxhash64("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(_shape, 10)
        for b in batches:
            for first, part in chunks(text_column(b.column(0))):
                x = feature_matrix(part, table)
                yield pa.record_batch([*(b.column(k).slice(first, len(part)) for k in (1, 2, 3)), pa.array([r.tobytes() for r in x], type=pa.binary())], names=["bucket", "order", "y", "x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: list, y: list) -> Iterator[pa.RecordBatch]:
            for g, b in _packages(np.frombuffer(b"".join(x)).reshape(-1, width), np.array(y)):
                yield pa.record_batch([pa.array([g.tobytes()], type=pa.binary()), pa.array([b.tobytes()], type=pa.binary())], names=["good", "bad"])

        key, x, y = None, [], []
        for r in ((b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()) for b in batches for i in range(b.num_rows)):
            if r[0] != key and x:
                yield from out(x, y)
                x, y = [], []
            key = r[0]
            x.append(r[2])
            y.append(r[1])
        if x:
            yield from out(x, y)

    rows = texts.join(wanted, ["doc_id", "order"]).dropDuplicates(["order"]).select("text", "bucket", "order", F.col("y").cast("int").alias("y"))
    rows = rows.mapInArrow(features, "bucket long, order long, y int, x binary").repartition("bucket").sortWithinPartitions("bucket", "order")
    packages = materialise(rows.mapInArrow(packed, "good binary, bad binary"), narrow=True)

    def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = None
            for b in batches:
                for g, z in zip(b.column(0), b.column(1)):
                    one = np.asarray(f(*(np.frombuffer(v.as_py()).reshape(-1, width) for v in (g, z))))
                    done = one if done is None else done + one
            if done is not None:
                yield pa.record_batch([pa.array([done.tobytes()], type=pa.binary())], names=["sum"])

        parts = [np.frombuffer(bytes(r["sum"])) for r in packages.mapInArrow(run, "sum binary").collect()]  # a row a task
        empty = np.asarray(f(np.empty((0, width)), np.empty((0, width))))
        return np.sum(parts, axis=0).reshape(empty.shape) if parts else empty

    return fit(total, width)


def score_quality(docs: DataFrame, model: RankModel) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= CUT): a row per row, whole texts.

    Null counts as empty; an empty text is scored by its features, which are all
    zero. Texts of any length are scored whole, equal texts alike. Rows without doc_id and repeated rows are scored like others, other columns
    are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(_shape, 10)
        for b in batches:
            for first, part in chunks(text_column(b.column(1))):
                s = model.score(feature_matrix(part, table))
                yield pa.record_batch([b.column(0).slice(first, len(part)).cast(pa.int64()), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
