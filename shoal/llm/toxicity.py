"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) are all it learns from. The risk
estimator corrects for the toxic share of U and keeps its negative part from falling
below zero (Kiryo et al., 2017).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._base import distinct_texts, held_out, pick
from shoal.llm._words import WordTable, chunks, split_words, text_column

#: Texts learnt from, of each kind, and features kept. These bound the training sample only.
POSITIVES, UNLABELLED, FEATURES = 3000, 8000, 1500
PREFIXES = (4, 5, 6)


def features(word: str) -> list[int]:
    """Hashes of a word and of its first letters, case and outer punctuation aside."""
    word = word.strip("\"'.,;:!?()[]{}<>|*#$%&").lower()
    if not word:
        return []
    return [zlib.crc32(word.encode("utf-8", "surrogatepass"))] + [zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n]


@dataclass
class PUModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -4.0
    prior: float = 0.0

    def score(self, present: set[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(present)), -40, 40))))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 1500, rate: float = 0.2, decay: float = 3e-5, keep: int = FEATURES) -> PUModel:
    """Linear classifier on feature presence, by the non-negative risk estimator.

    Steps of logistic loss come first, steps of sigmoid loss after them.

    Without positives, or with a prior of 0, everything scores low.
    """
    if not positive or not unlabelled or prior <= 0:
        return PUModel()
    prior = min(prior, 0.95)
    in_p, in_u = (Counter(f for doc in docs for f in doc.tolist()) for docs in (positive, unlabelled))
    n_p, n_u = len(positive), len(unlabelled)
    ranked = []
    for f, n in in_p.items():
        rate_u = (in_u[f] + 0.5) / (n_u + 1)
        z = (n - n_p * rate_u) / np.sqrt(n_p * rate_u)
        if n >= 4 and z >= 5 and n / n_p >= max(1.5, 0.5 / prior) * rate_u:  # a sure sign has 1 / prior
            ranked.append((-z, f))
    names = [f for _, f in sorted(ranked)[:keep]]
    at = {f: i for i, f in enumerate(names)}

    def matrix(docs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(docs), len(names) + 1), dtype=np.float32)
        x[:, -1] = 1
        for i, doc in enumerate(docs):
            x[i, [at[f] for f in doc.tolist() if f in at]] = 1
        return x

    p, u = matrix(positive), matrix(unlabelled)
    w = np.zeros(p.shape[1], dtype=np.float32)
    w[-1] = -2
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        up, uu, down = sigmoid(zp), sigmoid(zu), sigmoid(-zp)
        if step <= steps // 3:  # a start by logistic loss, whose slope doesn't vanish
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        else:  # bounded loss: texts far on the wrong side don't rule
            rest = uu.mean() - prior * up.mean()
            up, uu, down = up * (1 - up), uu * (1 - uu), up * (1 - up)
        rest_grad = u.T @ uu / n_u - prior * (p.T @ up) / n_p
        if rest >= 0:
            grad = -prior * (p.T @ down) / n_p + rest_grad
        else:
            grad = -rest_grad  # the estimate fell below zero: step back from that only
        grad = grad + decay * np.concatenate([w[:-1], [0]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return PUModel({f: float(x) for f, x in zip(names, w[:-1])}, float(w[-1]), prior)


def _presence(docs: DataFrame) -> list[np.ndarray]:
    """Distinct feature hashes of each text of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(np.array([f for w in t.as_py().split() for f in features(w)], dtype=np.uint32)).tobytes() for t in text_column(b.column(1))]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(out, type=pa.binary())], names=["doc_id", "f"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f binary").collect()  # as many as the sample has
    return [np.frombuffer(bytes(r["f"]), dtype=np.uint32) for r in sorted(rows, key=lambda r: r["doc_id"])]


def train_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PUModel:
    """Learn from documents whose fold isn't held out; equal texts count once."""
    texts = distinct_texts(docs, labels, "toxic")
    n, share = texts.where(F.col("y").isNotNull()).agg(F.count(F.lit(1)), F.avg("y")).first()
    p = _presence(pick(docs, texts.where("y = 1").orderBy("h").limit(positives)))
    u = _presence(pick(docs, texts.orderBy("h").limit(unlabelled)))
    return fit_nnpu(p, u, float(share or 0.0))


def toxicity_scorer(model: PUModel):
    """A function from an array of texts to their scores."""
    hits: list[tuple[int, ...]] = [()]

    def make(word: str) -> tuple[int]:
        found = tuple(f for f in features(word) if f in model.weights)
        if found:
            hits.append(found)
            return (len(hits) - 1,)
        return (0,)

    table = WordTable(make, 1, limit=100_000)

    def score(texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), model.score(set()))
        for first, part in chunks(texts):
            words, at, offsets = split_words(part)
            kind = table.lookup(words)[:, 0].astype(np.int64)[at]
            where = np.flatnonzero(kind)
            rows = np.searchsorted(offsets, where, side="right") - 1
            cut = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True]))) if len(rows) else []
            for s, e in zip(cut[:-1], cut[1:]):
                out[first + int(rows[s])] = model.score({f for k in set(kind[where[s:e]].tolist()) for f in hits[k]})
        return out

    return score


def score_toxicity(docs: DataFrame, model: PUModel) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row, whole texts.

    Null counts as empty; an empty text has the score of a text without any feature.
    Texts of any length are scored whole, equal texts alike, wherever they stand.
    Rows without doc_id and repeated rows are scored like others, other columns are
    ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = toxicity_scorer(model)
        for b in batches:
            s = score(text_column(b.column(1)))
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: PUModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below 0.5."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = toxicity_scorer(model)
        for b in batches:
            yield b.filter(pa.array(score(text_column(b.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
