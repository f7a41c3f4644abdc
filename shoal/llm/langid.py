"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._base import distinct_texts, held_out, pick, ranked
from shoal.llm._words import WordTable, chunks, split_words, sums, text_column

#: Hash buckets of subwords, size of their embeddings, texts learnt from per language (a bound on training only).
BUCKETS, SIZE, PER_LANGUAGE = 4096, 16, 400
UNKNOWN = "und"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of the words' letters, their ends marked, and of the whole words; and whose they are."""
    import regex

    text = regex.sub(r"[^\p{L}\n]+", "", "\n" + "\n".join(words).lower() + "\n")
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    end = at == 10
    word = np.cumsum(end) - 1  # a mark belongs to the word after it
    letter = ~end
    pad = np.concatenate([at, np.full(2, 10, dtype=np.uint64)])
    second, third = pad[1:-1], pad[2:]
    one, two, three = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = letter | (second != 10)
    inner = (second != 10) & (letter | (third != 10))  # the letter in the middle says whose it is
    codes = [at[letter] * one, (at * one + second * two + np.uint64(1))[pairs], (at * one + second * two + third * three + np.uint64(2))[inner]]
    owner = [word[letter], word[pairs], word[inner]]
    begin = np.flatnonzero(letter & np.concatenate(([True], end[:-1])))
    if len(begin):
        place = (np.arange(len(at)) - np.maximum.accumulate(np.where(end, np.arange(len(at)), -1))).astype(np.uint64)
        spelt = _mix(at + (place << np.uint64(32)))
        spelt[end] = 0
        codes.append(np.add.reduceat(spelt, begin) + np.uint64(3))
        owner.append(word[begin])
    return (_mix(np.concatenate(codes)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)


@dataclass
class LanguageModel:
    languages: list[str]
    parts: np.ndarray  # (BUCKETS, languages): what a subword adds to the logits, embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0  # calibrated probability under which a text counts as unknown

    def rows(self, words: list[str]) -> np.ndarray:
        """What each word adds to the logits' sums, and how many subwords it has."""
        at, owner = subwords(words)
        sums_ = [np.bincount(owner, weights=self.parts[at, k], minlength=len(words)) for k in range(len(self.languages))]
        return np.stack([*sums_, np.bincount(owner, minlength=len(words))], axis=1)

    def probabilities(self, total: np.ndarray) -> np.ndarray:
        """Of texts whose words' rows have these sums."""
        z = (total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_languages(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 30, rate: float = 0.02, batch: int = 64, seed: int = 3, reject_share: float = 0.001) -> LanguageModel:
    """Minibatch gradient descent on all but a fifth, by which the temperature and rejection are set.

    ``bags``: buckets and counts of each text. The rejection threshold is the quantile
    ``reject_share`` of the calibrated probabilities of that fifth.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not names:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(1))
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(bags))
    aside, learn = order[: len(order) // 5], order[len(order) // 5 :]
    e, w, b = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.1, (SIZE, len(names))).astype(np.float32), np.zeros(len(names), dtype=np.float32)
    adam = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, r in enumerate(rows):
            x[i, bags[r][0]] = bags[r][1] / max(1, bags[r][1].sum())
        return x

    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    step = 0
    for _ in range(epochs):
        for at in range(0, len(learn), batch):
            rows = rng.choice(learn, min(batch, len(learn)))
            x, step = dense(rows), step + 1
            mean = x @ e
            out = softmax(mean @ w + b)
            out[np.arange(len(rows)), y[rows]] -= 1
            out /= len(rows)
            for k, (p, g) in enumerate(((e, x.T @ (out @ w.T)), (w, mean.T @ out), (b, out.sum(axis=0)))):
                m, v = adam[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = LanguageModel(names, (e @ w).astype(np.float32), b.astype(np.float64))
    if len(aside):
        z, truth = np.concatenate([dense(aside[i : i + 256]) @ model.parts for i in range(0, len(aside), 256)]) + b, y[aside]
        grid = np.geomspace(0.5, 10, 30)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()))
        model.reject = float(np.quantile(softmax(z / model.temperature).max(axis=1), reject_share))
    return model


def train_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from text and lang of documents whose fold isn't held out; equal texts count once."""
    texts = distinct_texts(docs.where(F.col("lang").isNotNull()), label="lang")
    chosen = pick(docs, ranked(texts, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for t in text_column(b.column(1)):
                bag = np.bincount(subwords(t.as_py().split())[0], minlength=BUCKETS)
                at.append(np.flatnonzero(bag).astype(np.int32).tobytes())
                n.append(bag[bag > 0].astype(np.int32).tobytes())
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), pa.array(at, type=pa.binary()), pa.array(n, type=pa.binary())], names=["doc_id", "y", "at", "n"])

    rows = sorted(chosen.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y string, at binary, n binary").collect(), key=lambda r: r["doc_id"])
    bags = [(np.frombuffer(bytes(r["at"]), dtype=np.int32), np.frombuffer(bytes(r["n"]), dtype=np.int32)) for r in rows]
    kept = [i for i, (at, _) in enumerate(bags) if len(at)]
    return fit_languages([bags[i] for i in kept], [rows[i]["y"] for i in kept])


def identify_languages(docs: DataFrame, model: LanguageModel, reject: float | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: a row per row, whole texts.

    ``und`` with score 0 if a text is null or has no letter; ``und`` too if the
    calibrated probability is below ``reject`` (the model's own threshold if None).
    ``rejected`` says whether it is below the model's own threshold. Of languages with
    equal scores the first by name is taken; texts of any length are read whole.
    Rows without doc_id and repeated rows are handled like others, other columns are
    ignored, an empty table gives an empty result.
    """
    least = model.reject if reject is None else reject

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model.rows, len(model.languages) + 1, many=True)
        for b in batches:
            for first, part in chunks(text_column(b.column(1))):
                words, at, offsets = split_words(part)
                total = sums(table.lookup(words)[at], offsets)
                p = model.probabilities(total)
                best, known = p.argmax(axis=1), total[:, -1] > 0
                score = np.where(known, p.max(axis=1), 0.0)
                pred = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), (known & (score >= least)).tolist())]
                yield pa.record_batch([b.column(0).slice(first, len(part)).cast(pa.int64()), pa.array(pred, type=pa.string()), pa.array(score), pa.array(~known | (score < model.reject))], names=["doc_id", "lang_pred", "score", "rejected"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
