"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters run over learned byte embeddings (six bytes wide, two apart).
The largest rectified response of each filter in a chunk goes into a hidden
layer, whose units are max-pooled over the chunks of the document and combined
into one probability.

Scoring uses tables: the embedding and a filter's weights for a pair of bytes
are multiplied out once, so a response is three table rows and a sum.

The network is fitted by gradient descent on about ``PER_CLASS`` labelled rows
of each class, and sees all chunks of each text, as it does in scoring.

Edge cases: an empty or null text is one empty chunk and gets a score; with no
labels, or one class only, the score is the rate of label 1; labels that
repeat a doc_id count as their maximum; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import fold_of, small_batches
from keyfold.llm.toxicity import labelled

#: Labelled rows of a class that the network is fitted on.
PER_CLASS = 1000
CHUNK, STEP = 1024, 896
EMBED, FILTERS, HIDDEN = 4, 16, 16
#: Passes over the labelled rows; chosen on a part of the rows to learn from.
PASSES = 16


def chunks_of(raw: bytes) -> list[bytes]:
    """Overlapping chunks that cover all bytes; one empty chunk of an empty text."""
    return [raw[k : k + CHUNK] for k in range(0, max(1, len(raw) - (CHUNK - STEP)), STEP)]


def pack(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks as rows of bytes, filled up with zeros; number of filter positions that each has)."""
    x = np.frombuffer(b"".join(c.ljust(CHUNK, b"\0") for c in chunks), np.uint8).reshape(len(chunks), CHUNK)
    return x, np.array([max(0, min(CHUNK // 2 - 2, (len(c) + 1) // 2)) for c in chunks])


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": rng.normal(size=(256, EMBED)).astype(np.float32) * 0.5, "filter": n(6 * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "hidden": n(FILTERS, HIDDEN), "hbias": np.full(HIDDEN, 0.1, np.float32), "out": n(HIDDEN, 1)[:, 0], "obias": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def _pool(self, act: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Largest rectified response in each chunk's own positions."""
        mask = np.arange(act.shape[1])[None] < valid[:, None]
        act *= mask[:, :, None]
        return act.max(axis=1)

    def _head(self, vec: np.ndarray, owner: np.ndarray, n: int):
        p = self.p
        hid = np.maximum(vec @ p["hidden"] + p["hbias"], 0)
        top = np.maximum.reduceat(hid, np.searchsorted(owner, np.arange(n)))
        return hid, top, top @ p["out"] + p["obias"][0]

    def tables(self) -> list[np.ndarray]:
        e, w = self.p["embed"], self.p["filter"].reshape(3, 2, EMBED, FILTERS)
        # A pair read as a little-endian number: its first byte is the low one.
        return [((e @ w[k, 1])[:, None, :] + (e @ w[k, 0])[None, :, :]).reshape(65536, FILTERS) for k in range(3)]

    def score(self, texts: list[str | None], tables: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1, by all chunks of each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        parts = [chunks_of((t or "").encode("utf-8", "replace")) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in parts])
        flat = [c for cs in parts for c in cs]
        vec = []
        for k in range(0, len(flat), 64):
            x, valid = pack(flat[k : k + 64])
            pairs = x.view("<u2")
            act = tables[0].take(pairs[:, :-2], axis=0)
            act += tables[1].take(pairs[:, 1:-1], axis=0)
            act += tables[2].take(pairs[:, 2:], axis=0)
            act += self.p["bias"]
            np.maximum(act, 0, out=act)
            vec.append(self._pool(act, valid))
        z = self._head(np.concatenate(vec), owner, len(texts))[2]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def step(self, x: np.ndarray, valid: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss over documents."""
        p, n = self.p, len(y)
        m = CHUNK // 2 - 2
        emb = p["embed"][x].reshape(len(x), CHUNK // 2, 2 * EMBED)
        cols = np.concatenate([emb[:, k : k + m] for k in range(3)], axis=2)
        act = np.maximum(cols @ p["filter"] + p["bias"], 0)
        vec = self._pool(act, valid)
        hid, top, z = self._head(vec, owner, n)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight).astype(np.float32)
        g = {"out": top.T @ dz, "obias": dz.sum(keepdims=True)}
        d = dz[:, None] * p["out"]
        is_top = hid == top[owner]
        ties = np.add.reduceat(is_top.astype(np.float32), np.searchsorted(owner, np.arange(n)))
        dh = (d / ties)[owner] * is_top
        dh *= hid > 0
        g["hidden"], g["hbias"] = vec.T @ dh, dh.sum(axis=0)
        dv = dh @ p["hidden"].T
        da = np.zeros_like(act)
        da[np.arange(len(x))[:, None], act.argmax(axis=1), np.arange(FILTERS)[None]] = dv
        da *= act > 0
        flat = da.reshape(-1, FILTERS)
        g["filter"], g["bias"] = cols.reshape(-1, 6 * EMBED).T @ flat, flat.sum(axis=0)
        dc = (flat @ p["filter"].T).reshape(len(x), m, 6 * EMBED)
        de = np.zeros((len(x), CHUNK // 2, 2 * EMBED), np.float32)
        for k in range(3):
            de[:, k : k + m] += dc[:, :, 2 * EMBED * k : 2 * EMBED * (k + 1)]
        de = de.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(x.ravel(), de[:, k], minlength=256) for k in range(EMBED)], axis=1).astype(np.float32)
        return g


def fit(texts: list[str], labels: list[int], rate: float, passes: int = PASSES, seed: int = 3) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    if len(set(labels)) < 2:
        net.constant = rate
        return net
    parts, y = [chunks_of(t.encode("utf-8", "replace")) for t in texts], np.array(labels, np.float32)
    share = np.where(y == 1, rate / (y == 1).mean(), (1 - rate) / (y == 0).mean()).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second, t = {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    total = passes * -(-len(y) // 32)
    for _ in range(passes):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 32):
            docs = order[k : k + 32]
            chosen = [parts[d] for d in docs]
            owner = np.repeat(np.arange(len(docs)), [len(c) for c in chosen])
            x, valid = pack([c for cs in chosen for c in cs])
            g, t = net.step(x, valid, owner, y[docs], share[docs] / len(docs)), t + 1
            rate_now = 0.01 * (1 - 0.9 * t / total)
            for name, v in net.p.items():  # Adam
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
                v -= (rate_now * first[name] / (1 - 0.9**t) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    return fit(*labelled(docs, labels, "quality", 3, 1, per_class))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(shared), "doc_id long, score double")


def _scorer(shared):
    def run(batches):
        tables = shared.value.tables()
        for batch in small_batches(batches, 1, 500_000):
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(texts, tables), pa.float64())], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned outside fold 1 of 3."""
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, all columns kept; each row is judged where it is read, with no join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        tables = shared.value.tables()
        for batch in small_batches(batches, at, 500_000):
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array(shared.value.score(texts, tables) >= threshold))

    return docs.mapInArrow(run, docs.schema)
