"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary classifier over hashed
byte trigrams predicts that bit. A text gets the language whose codeword has
the least loss, bits weighted by how well they are learned. The loss of the
runner-up tells whether the choice is ambiguous.

The classifiers are fitted on at most about ``PER_CLASS`` labelled rows of
each language; every row is then scored by its whole text, with no shuffle.

Edge cases: a null text, or one without a letter, is "und" with score 0; a
null lang is never learned; with one learned language every text with letters
gets it; with none all are "und"; repeated rows are scored one by one; extra
columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import class_sample, fold_of, small_batches

#: Rows of a language that the classifiers are fitted on.
PER_CLASS = 400
BUCKETS = 4096
#: A smaller lead in loss over the second codeword counts as ambiguous.
LEAD = 0.5
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray:
    """Root-scaled counts of hashed byte trigrams of the whole text, at unit length."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    x = np.sqrt(np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)).astype(np.float32)
    return x / max(1e-9, float(np.sqrt(x @ x)))


def codewords(n: int) -> np.ndarray:
    """n codewords of +-1: the exhaustive code for few classes, else seeded random columns without repeats."""
    if n <= 5:
        return np.array([[1.0 if k == n - 1 or not bit >> k & 1 else -1.0 for bit in range(1, 2 ** (n - 1))] for k in range(n)]).reshape(n, max(0, 2 ** (n - 1) - 1) if n else 0)
    rng, columns = np.random.default_rng(5), set()
    while len(columns) < max(31, 6 * int(np.ceil(np.log2(n)))):
        c = tuple(rng.choice([-1.0, 1.0], n))
        if abs(sum(c)) <= n - 2 and tuple(-x for x in c) not in columns:
            columns.add(c)
    return np.array(sorted(columns)).T


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        return (np.log1p(np.exp(-np.clip(f[:, None, :] * self.code[None], -30, 30))) * self.trust).sum(axis=2)


def fit(texts: list[str], langs: list[str], steps: int = 300) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    x = np.stack([features(t) for t in texts])
    k = np.searchsorted(names, langs)
    share = 1 / np.bincount(k)[k]
    target, weight = code[k], (share / share.sum())[:, None]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):  # logistic loss, gradient with momentum
        g = (-target * weight / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))).astype(np.float32)
        vw, vb = 0.9 * vw + x.T @ g + 1e-6 * w, 0.9 * vb + g.sum(axis=0)
        w, b = w - 8 * vw, b - 2 * vb
    right = ((x @ w + b) * target > 0).mean(axis=0)
    return Model(names, code, w, b, np.log((right + 0.01) / (1.01 - right)) / np.log(101))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""

    def run(batches):
        for batch in small_batches(batches, 1):
            texts = batch.column(1).to_pylist()
            lang, score, doubt = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            at = [i for i, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
            for s in range(0, len(at), 256):
                part = at[s : s + 256]
                loss = model.losses(np.stack([features(texts[i]) for i in part]))
                p = np.exp(loss.min(axis=1, keepdims=True) - loss)
                p /= p.sum(axis=1, keepdims=True)
                lead = np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) if len(model.langs) > 1 else np.full(len(part), np.inf)
                for i, best, row, gap in zip(part, loss.argmin(axis=1), p, lead):
                    lang[i], score[i], doubt[i] = model.langs[best], float(row[best]), bool(gap < LEAD)
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def train(docs: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Model:
    """Fit on rows with a lang, outside the held-out fold."""
    rows = docs.where(fold_of(F.col("doc_id"), folds) != held_out).where("lang is not null and text is not null")
    got = class_sample(rows.select("doc_id", "text", "lang"), "lang", per_class).select("text", "lang").collect()
    return fit([r[0] for r in got], [r[1] for r in got])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
