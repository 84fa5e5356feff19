"""Toxicity by two class-conditional Kneser-Ney language models.

One bigram model of words is estimated for toxic texts and one for ordinary
ones. Both discount absolutely and back off from the class's bigrams to its
unigrams, and from there to one shared distribution over both classes. Bigrams
are counted as they occur, lower orders by their distinct left neighbours
(Kneser-Ney continuation counts); copies of a text count once. An expression that a class has rarely or never shown
takes nearly all its probability from the shared counts, so it decides little.

Spark counts words and bigrams over all labelled rows to learn from, so what
the models are estimated from grows with the input: tasks count blocks of
texts, and the sums, continuation counts and counts of counts are aggregated.
A word that occurs once is unknown and decides nothing, a bigram that occurs
once is left to the totals from which the weight of backing off comes; all
others have ratios of their own, however many they are. The ``VOCABULARY`` most
frequent words and the ``BIGRAMS`` most frequent pairs of them are handed to
the tasks. Ratios of the rest are made by Spark and written to the shared
folder, dealt by a hash and sorted by it in parts of about ``GROUP`` rows; a task
that scores looks up there what its block of texts needs, in mapped files, so
neither texts nor questions nor answers are shuffled and nobody holds the rest
as a whole (a bitmap of bounded size spares look-ups, it decides none).
In the rest a word stands as a hash of 62 bits, chosen so that no two
counted words share one; a scored word must agree in 64 bits more.

A text's evidence is the difference of the two log-likelihoods normalised by
length: over the whole text, over its most telling windows of ``WINDOWS``
words, and over its ``TOP`` most telling distinct words. The number of words
enters as well, since a maximum over more windows is larger by chance; nothing
else does. A logistic calibration turns them into one probability at the
labels' natural rate. It is fitted on texts that the models have not counted: a
hash sample of distinct texts, at most ``RESERVED`` of each class and about
``PER_CLASS`` texts. Every document is scored by its whole text, where it is
read.

Edge cases: an empty or null text has no evidence and gets the base rate; where
one of the classes has no text to count or none to calibrate on, the score is
that rate (0 without labels); labels that repeat a doc_id count as their
maximum; texts are copies if equal but for case; extra columns do not matter.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass, replace
from functools import lru_cache
from hashlib import blake2b
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import class_sample, cut, discard, fold_of, mix64, shared_dir, shuffles_freed, small_batches, small_enough

#: Labelled texts of a class that the calibration is fitted on.
PER_CLASS = 2000
#: Largest share of a class's texts that is kept from the models for calibration.
RESERVED = 0.25
#: Words and bigrams whose ratios are handed to every task, at most; those of the rest are looked up.
VOCABULARY = 1 << 18
BIGRAMS = 1 << 20
#: Numbers of frequent words are below, hashes of all others above.
_FIRST = 1 << 20
#: Stands for the second word where both are frequent; the first is then ``first * _FIRST + second``. A word alone has _ALONE.
_BOTH, _ALONE = -2, -1
#: Rows of the rest that a file of it holds, about.
GROUP = 1 << 17
#: Words that tasks get as a list instead of a bitmap, at most.
FEW = 1 << 16
#: Bits of the bitmap of the rest, as a power of 2, at most.
BITS = 28
WINDOWS = (4, 30, 120)
#: So many of a text's most telling distinct words are taken together.
TOP = (2, 4)
N_FEATURES = 2 + len(WINDOWS) + len(TOP)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def hashes(words: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word a number of 62 hashed bits above all numbers of frequent words, and 64 bits more."""
    key = salt.to_bytes(8, "little")
    raw = b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16, key=key).digest() for w in words)
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0] & ((1 << 62) - 1) | (1 << 62), both[:, 1]


def packed(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams as tables have them: frequent words in one number."""
    both = (u < _FIRST) & (w < _FIRST) & (w >= 0)
    return np.where(both, u * _FIRST + w, u), np.where(both, _BOTH, w)


def mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits by which packed bigrams, or words alone, are dealt and sorted; with ``w`` they tell ``u``."""
    return mix64(mix64(np.asarray(u)) + np.asarray(w).astype(np.uint64))


def spots(u: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Places of packed bigrams, or words alone, in a bitmap."""
    return (mixed(u, w) >> np.uint64(64 - bits)).astype(np.int64)


def marked(bitmap: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which bigrams may be in what the bitmap was made of."""
    at = spots(u, w, len(bitmap).bit_length() + 2)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def starts(n: np.ndarray) -> np.ndarray:
    """Whether each word is the first of its text."""
    first = np.zeros(int(n.sum()), bool)
    at = np.cumsum(n) - n
    first[at[n > 0]] = True
    return first


@lru_cache(maxsize=1 << 14)
def mapped(name: str) -> np.ndarray:
    """An array of the shared folder, mapped; one in a store that cannot be mapped is copied first."""
    fs, path = pafs.FileSystem.from_uri(name)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with tempfile.TemporaryDirectory() as folder:  # what is mapped outlives its name
        copy = os.path.join(folder, "part.npy")
        with fs.open_input_stream(path) as src, open(copy, "wb") as to:
            shutil.copyfileobj(src, to)
        return np.load(copy, mmap_mode="r")


@dataclass
class Rest:
    """Ratios in files of the shared folder: of the hash's first ``bits`` bits each value has its words and its bigrams."""

    files: dict[int, tuple[str, str]]
    bits: int

    def look_up(self, u: np.ndarray, w: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words (``kind`` 0) or packed bigrams (1) the rest has, and a column of values for each that it has."""
        key = mixed(u, w)
        order = np.argsort(key)
        key, w = key[order], np.asarray(w)[order]
        ends = np.searchsorted(key >> np.uint64(64 - self.bits) if self.bits else key * np.uint64(0), np.arange(1 << self.bits, dtype=np.uint64), "right").tolist()
        hit, values = np.zeros(len(key), bool), []
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if a == b or k not in self.files:
                continue
            table = mapped(self.files[k][kind])
            keys, seconds = table[0].view(np.uint64), table[1]
            at = np.searchsorted(keys, key[a:b])
            found, open_ = np.full(b - a, -1), np.arange(b - a)
            while len(open_):  # nearly always one row has the key
                open_ = open_[at[open_] < len(keys)]
                open_ = open_[keys[at[open_]] == key[a:b][open_]]
                same = seconds[at[open_]] == w[a:b][open_]
                found[open_[same]] = at[open_[same]]
                open_ = open_[~same]
                at[open_] += 1
            hit[a:b] = found >= 0
            values.append(table[2:, found[found >= 0]])
        out = np.zeros(len(key), bool)
        out[order] = hit
        got = np.concatenate(values, axis=1) if values else np.zeros((3 if kind == 0 else 1, 0), np.int64)
        back = np.argsort(order[hit])
        return out, got[:, back]


@dataclass
class Model:
    vocab: dict[str, int]
    uni: np.ndarray  # log ratio of each word without context; the last entry is for unknown words
    back: np.ndarray  # log ratio of the backing-off weights after each word; last: unknown
    keys: np.ndarray  # sorted bigrams of a class, first * V + second
    bi: np.ndarray  # their log ratios
    coef: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    base: float
    rest: Rest | None = None  # ratios of all other words and bigrams
    bitmap: np.ndarray | None = None  # of the rest's bigrams and words alone
    salt: int = 0

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of all words, one text after the other, how many each text has, and the distinct words that are not frequent.

        If there is a rest, these are numbered in their order, after the number of unknown words.
        """
        words = [words_of(t) for t in texts]
        n, flat, v = np.array([len(w) for w in words], np.int64), list(chain.from_iterable(words)), len(self.vocab)
        ids = np.fromiter(map(self.vocab.get, flat, repeat(v)), np.int64, len(flat))
        found: dict[str, int] = {}
        if self.bitmap is not None:
            at = np.flatnonzero(ids == v)
            ids[at] = [found.setdefault(flat[i], v + 1 + len(found)) for i in at.tolist()]
        return ids, n, list(found)

    def frequent(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where bigrams stand among the frequent ones, and whether they do."""
        v = len(self.vocab)
        if not len(self.keys):
            return np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        key = first * (v + 1) + second
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (second < v)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """One row of features for each text."""
        ids, n, other = self.numbers(texts)
        v, uni, back = len(self.vocab), self.uni, self.back
        if self.rest is not None:
            codes, check = hashes(other, self.salt)
            may = np.flatnonzero(marked(self.bitmap, codes, np.full(len(codes), _ALONE)))
            hit, (one, weight, more) = self.rest.look_up(codes[may], np.full(len(may), _ALONE), 0)
            same = more == check[may[hit]]
            mine, at = np.zeros(len(other), bool), may[hit][same]
            far_uni, far_back = np.zeros(len(other)), np.zeros(len(other))
            mine[at], far_uni[at], far_back[at] = True, one.view(float)[same], weight.view(float)[same]
            uni, back, code = np.concatenate([uni, far_uni]), np.concatenate([back, far_back]), np.concatenate([np.arange(1, v + 2), codes])
            ids = np.concatenate([np.arange(v + 1), np.where(mine, np.arange(len(other)) + v + 1, v)])[ids]
        llr = uni[ids]
        if len(ids) > 1:
            inside = ~starts(n)[1:]
            at, seen = self.frequent(ids[:-1], ids[1:])
            after = back[ids[:-1]] + llr[1:]
            after[seen] = self.bi[at[seen]]
            if self.rest is not None:
                at = np.flatnonzero(inside & ~seen & (ids[:-1] != v) & (ids[1:] != v))
                u, w = packed(code[ids[at]], code[ids[at + 1]])
                may = marked(self.bitmap, u, w)
                hit, (ratio,) = self.rest.look_up(u[may], w[may], 1)
                after[at[may][hit]] = ratio.view(float)
            llr[1:] = np.where(inside, after, llr[1:])
        out = np.zeros((len(texts), N_FEATURES))
        end = 0
        for i, k in enumerate(n):
            if k:
                total = np.concatenate([[0], np.cumsum(llr[end : end + k])])
                out[i, 0], out[i, 1] = total[-1] / k, np.log(k)
                for j, size in enumerate(WINDOWS, 2):
                    s = min(size, k)
                    out[i, j] = (total[s:] - total[:-s]).max() / s
                telling = np.sort(uni[np.unique(ids[end : end + k])])[::-1]
                for j, size in enumerate(TOP, 2 + len(WINDOWS)):
                    out[i, j] = telling[:size].sum() / size
                end += k
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.evidence(texts)
        z = np.clip(np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1) @ self.coef, -30, 30)
        p = 1 / (1 + np.exp(-z))
        return np.where(x.any(axis=1), p, self.base)


def _steps(n: list[float]) -> np.ndarray:
    """What counts 0, 1, 2 and 3 or more lose: modified Kneser-Ney discounts, from how often the counts 1 to 4 occur."""
    n = [max(1.0, float(k)) for k in n]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.3 * k, 0.9 * k) for k in (1, 2, 3))])


def word_counts(texts: list[str], weight: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct words of some texts and how often they occur, each text taken ``weight`` times."""
    code: dict[str, int] = {}
    rows = [[code.setdefault(w, len(code)) for w in words_of(t)] for t in texts]
    ids = np.fromiter((i for r in rows for i in r), np.int64, sum(map(len, rows)))
    return list(code), np.bincount(ids, np.repeat(weight, [len(r) for r in rows]), minlength=len(code))


def pair_counts(texts: list[str], labels: np.ndarray, weight: np.ndarray, vocab: dict[str, int], others=None) -> tuple[np.ndarray, ...]:
    """The two words of distinct bigrams of some texts, and their counts in ordinary and toxic ones.

    0 is the start of a text, 1 + ``vocab[w]`` a word, 1 + the number of words an unknown one. ``others``, if given, tells
    the numbers of a list of words that are not in ``vocab``.
    """
    rows = [words_of(t) for t in texts]
    size = np.array([1 + len(r) for r in rows], np.int64)
    flat, v, far = list(chain.from_iterable(rows)), len(vocab), {}
    own = np.fromiter(map(vocab.get, flat, repeat(v)), np.int64, len(flat)) + 1
    if others is not None:
        at = np.flatnonzero(own == v + 1)
        own[at] = [v + 2 + far.setdefault(flat[i], len(far)) for i in at.tolist()]
    ids, inside = np.zeros(int(size.sum()), np.int64), np.ones(int(size.sum()), bool)
    inside[np.cumsum(size) - size] = False
    ids[inside] = own
    inside = inside[1:]
    keys, at = np.unique((ids[:-1] << 32 | ids[1:])[inside], return_inverse=True)
    toxic, times = np.repeat(labels, size)[1:][inside] == 1, np.repeat(weight, size)[1:][inside]
    code = np.arange(v + 2) if others is None else np.concatenate([np.arange(v + 2), others(list(far))])
    counts = [np.bincount(at, times * some, minlength=len(keys)) for some in (~toxic, toxic)]
    return code[keys >> 32], code[keys & 0xFFFFFFFF], *counts


@dataclass
class Totals:
    """Sums over all words and bigrams; the first index is the class (ordinary, toxic, for words both together)."""

    size: int  # words, with the start of a text, and the unknown one if there is any
    before: np.ndarray  # sum of the distinct words before each word
    words: np.ndarray  # words that have 1, 2, 3, 4, and 3 or more distinct words before them
    some: int  # words that have any
    spread: np.ndarray  # by class: bigrams that occur once to four times


@dataclass
class Values:
    """By word: what the probabilities of bigrams with it are made of, by class."""

    after: np.ndarray  # occurrences after the word
    left: np.ndarray  # weight of backing off after it
    p: np.ndarray  # its own probability

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        return np.log(self.p[1] / self.p[0]), np.log(self.left[1] / self.left[0])


def word_values(t: Totals, before: np.ndarray, after: np.ndarray, times: np.ndarray) -> Values:
    """Of words, from their distinct words before (3 rows), occurrences after (2) and words that follow once, twice, more often (2 by 3)."""
    shared = np.maximum(before[2] - 0.75, 0) / max(1, t.before[2])
    shared += (1 - (t.before[2] - 0.75 * t.some) / max(1, t.before[2])) / t.size
    p, left = [], []
    for k in (0, 1):
        step, total = _steps(t.words[k][:4]), max(1.0, t.before[k])
        lost = step[1:] @ t.words[k][[0, 1, 4]]
        p.append((before[k] - step[np.minimum(before[k], 3).astype(np.int64)]) / total + (lost / total if t.before[k] else 1.0) * shared)
        left.append(np.where(after[k] > 0, (_steps(t.spread[k])[1:] @ times[k]) / np.maximum(after[k], 1), 1.0))
    return Values(np.asarray(after, float), np.array(left), np.array(p))


def pair_ratios(t: Totals, counts, after: np.ndarray, left: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log ratios of bigrams, from their counts, what is known of the first word, and the probabilities of the second."""
    out = np.zeros(len(counts[0]))
    for k, sign in ((0, -1), (1, 1)):
        kept = counts[k] - _steps(t.spread[k])[np.minimum(counts[k], 3).astype(np.int64)]
        out += sign * np.log(kept / np.maximum(after[k], 1) + left[k] * p[k])
    return out


def _model(words: list[str], t: Totals, values: Values, u, w, *counts) -> Model:
    """The two models, without calibration, of words, what is known of the start, them and the unknown word, and bigrams of words."""
    v = len(words)
    one, back = (x[1 : v + 1] for x in values.ratios())
    ratio = pair_ratios(t, counts, values.after[:, u], values.left[:, u], values.p[:, w])
    keys = (u - 1) * (v + 1) + w - 1
    order = np.argsort(keys)
    blank = np.zeros(N_FEATURES)
    return Model({x: i for i, x in enumerate(words)}, np.append(one, 0.0), np.append(back, 0.0), keys[order], ratio[order], np.zeros(1 + N_FEATURES), blank, blank + 1, 0.0)


def _estimate(texts: list[str], labels: np.ndarray) -> Model:
    """The models of texts in memory, as ``estimate`` makes them of rows."""
    once = list({(tuple(words_of(t)), int(y)): (t, int(y)) for t, y in zip(texts, labels)}.values())
    texts, labels, weight = [t for t, _ in once], np.array([y for _, y in once]), np.ones(len(once))
    found, times = word_counts(texts, weight)
    words = sorted(x for x, n in zip(found, times) if n >= 2)
    u, w, *n = pair_counts(texts, labels, weight, {x: i for i, x in enumerate(words)})
    v = len(words)
    count = lambda at, some=None: np.bincount(at, some, minlength=v + 2)
    before = np.array([count(w[n[0] > 0]), count(w[n[1] > 0]), count(w)])
    times = np.array([[count(u[k == 1]), count(u[k == 2]), count(u[k >= 3])] for k in n])
    by = np.array([[*((b == i).sum() for i in (1, 2, 3, 4)), (b >= 3).sum()] for b in before])
    t = Totals(v + 1 + int(before[2, v + 1] > 0), before.sum(axis=1), by, int((before[2] > 0).sum()), np.array([[(k == i).sum() for i in (1, 2, 3, 4)] for k in n]))
    own = (n[0] + n[1] >= 2) & (u > 0) & (u <= v) & (w <= v)
    return _model(words, t, word_values(t, before, np.array([count(u, k) for k in n]), times), u[own], w[own], n[0][own], n[1][own])


def least_kept(df: DataFrame, most: int) -> int | None:
    """The smallest ``n`` such that at most ``most`` rows have it or a larger one, none below 2; counts that differ by little stay or go together."""
    step = F.floor(F.log2("n") * 8).alias("step")
    steps = df.where("n >= 2").groupBy(step).agg(F.count(F.lit(1)), F.min("n")).collect()  # at most 8 for each doubling
    least, kept = None, 0
    for _, rows, low in sorted(steps, reverse=True):
        kept += rows
        if kept > most:
            break
        least = low
    return least


def most_frequent(df: DataFrame, most: int) -> DataFrame:
    """Rows with the largest ``n``, at most ``most`` of them and none below 2."""
    least = least_kept(df, most)
    return df.where(F.lit(False)) if least is None else df.where(F.col("n") >= least)


def bitmap_of(df: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the ``n`` rows (u, w): at most 2 ** ``BITS`` bits, which Spark sets in parts of 64 KiB."""
    bits = min(BITS, max(10, (16 * n).bit_length()))
    part = min(bits, 19)

    def place(batches):
        for b in batches:
            at = spots(np.asarray(b.column(0)), np.asarray(b.column(1)), bits)
            yield pa.record_batch([pa.array(at >> part), pa.array(at & ((1 << part) - 1))], names=["part", "at"])

    def fill(t: pa.Table) -> pa.Table:
        on = np.zeros(1 << part, np.uint8)
        on[np.asarray(t.column("at"))] = 1
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, raw in df.select("u", "w").mapInArrow(place, "part long, at long").groupBy("part").applyInArrow(fill, "part long, bits binary").collect():
        out[k << (part - 3) : (k + 1) << (part - 3)] = np.frombuffer(raw, np.uint8)
    return out


def stored(df: DataFrame, n: int) -> tuple[Rest, np.ndarray]:
    """The ``n`` rows (u, w, x, y, more) in files of a fresh shared folder, and their bitmap; tasks write both a part at a time."""
    bits = min(BITS, max(10, (16 * n).bit_length()))
    deal = min(bits - 3, (n // GROUP).bit_length())
    folder = f"{shared_dir(df.sparkSession)}/keyfold-rest-{uuid.uuid4().hex}"

    def place(batches):
        for b in batches:
            part = mixed(np.asarray(b.column(0)), np.asarray(b.column(1))) >> np.uint64(64 - deal) if deal else np.zeros(b.num_rows)
            yield pa.record_batch([pa.array(part.astype(np.int64)), *b.columns], names=["part", *b.schema.names])

    def write(t: pa.Table) -> pa.Table:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        part, mine = t.column("part")[0].as_py(), uuid.uuid4().hex  # a task that runs again writes other files
        u, w, *values = (np.asarray(t.column(c)) for c in ("u", "w", "x", "y", "more"))
        key = mixed(u, w)
        order, names = np.argsort(key), []
        for kind, (some, k) in enumerate(((w == _ALONE, 3), (w != _ALONE, 1))):
            at = order[some[order]]
            names.append(f"{folder}/{kind}-{part}-{mine}.npy")
            with fs.open_output_stream(f"{path}/{kind}-{part}-{mine}.npy") as to:
                np.save(to, np.stack([key[at].view(np.int64), *[np.ascontiguousarray(c[at]).view(np.int64) for c in (w, *values[:k])]]))
        on = np.zeros(1 << (bits - deal), np.uint8)
        on[(spots(u, w, bits) & ((1 << (bits - deal)) - 1))] = 1
        return pa.table({"part": pa.array([part], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary()), "files": pa.array([names], pa.list_(pa.string()))})

    out, files = np.zeros(1 << (bits - 3), np.uint8), {}
    dealt = df.select("u", "w", "x", "y", "more").mapInArrow(place, "part long, u long, w long, x double, y double, more long")
    for k, raw, names in dealt.groupBy("part").applyInArrow(write, "part long, bits binary, files array<string>").collect():
        out[k << (bits - deal - 3) : (k + 1) << (bits - deal - 3)] = np.frombuffer(raw, np.uint8)
        files[k] = tuple(names)
    return Rest(files, deal), out


def rare_words(words: DataFrame, names: Broadcast) -> tuple[DataFrame, int]:
    """Numbers (u), 64 bits more (more) and n of all words but the frequent ones, ``names``; a salt by which no two share a number."""
    for salt in range(100):

        def number(batches, salt=salt):
            for b in batches:
                w, n = b.column(0).to_pylist(), np.asarray(b.column(1))
                own = np.array([x not in names.value for x in w], bool)
                got = hashes([x for x, k in zip(w, own) if k], salt)
                yield pa.record_batch([pa.array(got[0]), pa.array(got[1]), pa.array(n[own])], names=["u", "more", "n"])

        out = cut(words.select("word", "n").mapInArrow(number, "u long, more long, n long"))
        if not out.groupBy("u").count().where("count > 1").limit(1).count():
            return out, salt
        discard(out)
    raise ValueError("words share numbers under each salt")


def sieve(rare: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """What tells the numbers u with n >= 2 from those below: bitmaps, each of those that the one before takes wrongly, and a list at last."""
    inside, others, levels = rare.where("n >= 2").select("u"), rare.where("n < 2").select("u"), []
    while (k := inside.count()) > FEW:
        of = _ALONE - 2 - len(levels)  # another hash for each
        levels.append(bitmap_of(inside.withColumn("w", F.lit(of).cast("long")), k))

        def taken(batches, bitmap=levels[-1], of=of):
            for b in batches:
                u = np.asarray(b.column(0))
                yield pa.record_batch([pa.array(u[marked(bitmap, u, np.full(len(u), of))])], names=["u"])

        inside, others = cut(others.mapInArrow(taken, "u long")), inside
    return levels, np.sort(np.asarray(inside.toArrow().column(0)))


def sifted(levels: list[np.ndarray], few: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which of the numbers that ``sieve`` has seen had n >= 2."""
    known, left = np.zeros(len(u), bool), np.arange(len(u))
    for i, bitmap in enumerate(levels):
        on = marked(bitmap, u[left], np.full(len(left), _ALONE - 2 - i))
        known[left[~on]] = i % 2 == 1
        left = left[on]
    known[left] = np.isin(u[left], few) ^ (len(levels) % 2 == 1)
    return known


def with_word(pairs: DataFrame, side: str, other: str, table: DataFrame) -> DataFrame:
    """``pairs`` left-joined by the word of one side, where it is a rare one; rows with a frequent word there are spread by both."""
    key = F.when(F.col(side) >= _FIRST, F.col(side)).otherwise(-1 - F.pmod(F.xxhash64(side, other), F.lit(1 << 30)))
    return pairs.join(table, key == F.col(table.columns[0]), "left")


def estimate(rows: DataFrame) -> Model:
    """The two models of rows (text, y, copies): each text counts 1 / ``copies``. Spark counts; the driver gets ``VOCABULARY`` words and ``BIGRAMS`` pairs."""

    def count_words(batches):
        for batch in small_batches(batches, 0):
            words, n = word_counts(batch.column(0).to_pylist(), 1 / np.asarray(batch.column(2)))
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(n)], names=["word", "n"])

    rows = rows.select("text", "y", "copies")
    words = cut(rows.mapInArrow(count_words, "word string, n double").groupBy("word").agg(F.round(F.sum("n")).cast("long").alias("n")))
    names = sorted(r[0] for r in most_frequent(words, VOCABULARY).select("word").collect())
    v, known = len(names), words.where("n >= 2").count()
    context, salt, rare, known_words = rows.sparkSession.sparkContext, 0, None, None
    if known > v:
        listed = context.broadcast(set(names))
        rare, salt = rare_words(words, listed)
        known_words = sieve(rare)
    shared = context.broadcast(({x: i for i, x in enumerate(names)}, known_words))

    def count_pairs(batches):
        vocab, known_words = shared.value

        def others(w: list[str]) -> np.ndarray:
            code, _ = hashes(w, salt)
            return np.where(sifted(*known_words, code), code, v + 1)

        for batch in small_batches(batches, 0):
            u, w, *n = pair_counts(batch.column(0).to_pylist(), np.asarray(batch.column(1)), 1 / np.asarray(batch.column(2)), vocab, None if known_words is None else others)
            yield pa.record_batch([pa.array(x) for x in (*packed(u, w), *n)], names=["u", "w", "c0", "c1"])

    def tally(batches):
        for t in joined_batches(batches):
            u, w, *n = (np.asarray(c) for c in t.columns)
            ids, at = np.unique(np.concatenate([u, w]), return_inverse=True)
            left, right = at[: len(u)], at[len(u) :]
            sums = [np.bincount(right, some, len(ids)) for some in (n[0] > 0, n[1] > 0, None)] + [np.bincount(left, k, len(ids)) for k in n]
            sums += [np.bincount(left, some, len(ids)) for k in n for some in (k == 1, k == 2, k >= 3)]
            spread = [0, 0, 0, *[(k == i).sum() for k in n for i in (1, 2, 3, 4)]]  # of all, in a row without a word
            yield pa.record_batch([pa.array(np.append(ids, -1)), *[pa.array(np.append(c, x).astype(float)) for c, x in zip(sums, spread)]], names=["id", *columns])

    pairs = rows.mapInArrow(count_pairs, "u long, w long, c0 double, c1 double").groupBy("u", "w").agg(*[F.round(F.sum(c)).cast("long").alias(c) for c in ("c0", "c1")])
    pairs = cut(pairs.selectExpr(f"if(w = {_BOTH}, u div {_FIRST}, u) as u", f"if(w = {_BOTH}, u % {_FIRST}, w) as w", "c0", "c1"), codec="zstd")
    columns = [*[f"b{i}" for i in range(3)], *[f"f{i}" for i in range(8)]]
    stats = cut(pairs.mapInArrow(tally, ", ".join(["id long", *[f"{c} double" for c in columns]])).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]))
    own = pairs.withColumn("n", F.expr("c0 + c1")).where(f"n >= 2 and u > 0 and u <> {v + 1} and w <> {v + 1}")
    own = cut(own, codec="zstd")
    discard(words, pairs)
    shared.destroy()
    if rare is not None:
        listed.destroy()
    spread = stats.where("id = -1").select(*columns[3:]).first() or [0] * 8
    stats = stats.where("id >= 0")
    sums = stats.agg(F.expr(f"count_if(id = {v + 1} and b2 > 0)"), F.expr("count_if(b2 > 0)"), *[F.coalesce(F.sum(f"b{k}"), F.lit(0.0)) for k in range(3)], *[F.expr(f"count_if(b{k} {c})") for k in range(3) for c in ("= 1", "= 2", "= 3", "= 4", ">= 3")]).first()
    t = Totals(known + 1 + sums[0], np.array(sums[2:5]), np.array(sums[5:]).reshape(3, 5), sums[1], np.array(spread).reshape(2, 4))

    def valued(x: np.ndarray) -> Values:
        return word_values(t, x[:3], x[3:5], x[5:].reshape(2, 3, -1))

    got = stats.where(F.col("id") < _FIRST).toArrow()
    common = np.zeros((len(columns), v + 2))
    common[:, np.asarray(got.column(0))] = [np.asarray(got.column(1 + i)) for i in range(len(columns))]
    values = valued(common)
    near = F.expr(f"u < {_FIRST} and w < {_FIRST}")
    least = least_kept(own.where(near), BIGRAMS)
    top = F.lit(False) if least is None else near & (F.col("n") >= least)
    kept = own.where(top).select("u", "w", "c0", "c1").toArrow()
    model = _model(names, t, values, *(np.asarray(kept.column(i)) for i in range(4)))
    rest, n = own.where(~top).select("u", "w", "c0", "c1"), own.count() - kept.num_rows + known - v
    if not n:
        discard(stats, own)
        return model
    held, parts = context.broadcast((t, values)), ("a0", "a1", "l0", "l1", "p0", "p1")

    def value_words(batches):
        for b in batches:
            x = valued(np.array([np.asarray(b.column(1 + i)) for i in range(len(columns))]))
            yield pa.record_batch([b.column(0), *[pa.array(c) for y in (x.after, x.left, x.p) for c in y], *map(pa.array, x.ratios())], names=["id", *parts, "one", "back"])

    def value_pairs(batches):
        t, values = held.value
        for b in batches:
            u, w = np.asarray(b.column(0)), np.asarray(b.column(1))
            joined = [np.asarray(c.fill_null(0.0)) for c in b.columns[4:]]
            pick = lambda common, code, far: np.array([np.where(code < _FIRST, common[k][np.where(code < _FIRST, code, 0)], far[k]) for k in (0, 1)])
            x = pair_ratios(t, [np.asarray(b.column(2)), np.asarray(b.column(3))], pick(values.after, u, joined[:2]), pick(values.left, u, joined[2:4]), pick(values.p, w, joined[4:]))
            yield pa.record_batch([pa.array(c) for c in (*packed(u, w), x)], names=["u", "w", "x"])

    none = [F.lit(None).cast("double").alias(c) for c in parts]
    all_pairs, made = rest.where(near).select("u", "w", "c0", "c1", *none), [own, stats]
    if rare is not None:
        far = cut(stats.where(F.col("id") >= _FIRST).mapInArrow(value_words, ", ".join(["id long", *[f"{c} double" for c in (*parts, "one", "back")]])))
        rest = with_word(rest.where(~near), "u", "w", far.select(F.col("id").alias("iu"), *parts[:4]))
        rest = with_word(rest, "w", "u", far.select(F.col("id").alias("iw"), *parts[4:])).select("u", "w", "c0", "c1", *parts)
        all_pairs, made = all_pairs.unionByName(rest), [*made, far, rare]
    table = all_pairs.mapInArrow(value_pairs, "u long, w long, x double").select("u", "w", "x", F.lit(0.0).alias("y"), F.lit(0).cast("long").alias("more"))
    if rare is not None:
        table = table.unionByName(far.join(rare.where("n >= 2"), F.col("id") == F.col("u")).select("u", F.lit(_ALONE).cast("long").alias("w"), F.col("one").alias("x"), F.col("back").alias("y"), "more"))
    files, bitmap = stored(table, n)
    discard(*made)
    held.destroy()
    return replace(model, rest=files, bitmap=bitmap, salt=salt)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 4, held_out: int = 2) -> Model:
    """Models of all labelled rows outside the fold, calibrated on the reserved texts to the natural rate of label 1."""
    known = labels.where(fold_of(F.col("doc_id"), folds) != held_out).where(F.col(column).isNotNull())
    y = cut(known.groupBy(F.col("doc_id").alias("id")).agg(F.max(column).cast("int").alias("y")))
    counts = {r[0]: r[1] for r in y.groupBy("y").count().collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    texts = docs.where("text <> ''").select("doc_id", "text", F.xxhash64(F.lower("text")).alias("hash"))
    copies = texts.drop("text").join(small_enough(y), F.col("doc_id") == F.col("id")).groupBy("y", "hash", "id").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    once = cut(copies.groupBy("y", "hash").agg(F.min(F.struct("id", "copies")).alias("one")).select("y", F.col("hash").alias("own"), "one.*"))
    n = {r[0]: r[1] for r in once.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for c in n:
        share = F.when(F.col("y") == c, min(RESERVED, PER_CLASS / n[c])).otherwise(share)
    once = once.withColumn("reserved", F.pmod(F.xxhash64("own", F.lit(17)), F.lit(1 << 30)) / float(1 << 30) < share)
    same = (F.col("doc_id") == F.col("id")) & (F.xxhash64(F.lower("text")).bitwiseXOR(F.col("own")) == 0)  # no key of the join: only rows whose id is there are hashed
    texts = texts.select("doc_id", "text")
    got = texts.join(F.broadcast(once.where("reserved")), same).dropDuplicates(["y", "own"])
    got = cut(got.select(F.expr("(own & -2L) | y").alias("doc_id"), "text"))  # about PER_CLASS texts a class
    if {r[0] for r in got.select(F.expr("doc_id & 1L")).distinct().collect()} != {0, 1} or once.where("not reserved").select("y").distinct().count() < 2:
        blank = _estimate([""], np.array([0]))
        blank.coef[0], blank.base = np.log((rate + 1e-9) / (1 - rate + 1e-9)), rate
        return blank
    model = estimate(texts.join(small_enough(once.where("not reserved")), same))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = sorted(by_text(got, shared, lambda m, texts: list(m.evidence(texts)), "array<double>").collect())
    shared.destroy()
    y, x = np.array([r[0] & 1 for r in found]), np.array([r[1] for r in found])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    weight = np.where(y == 1, rate / max(1, (y == 1).sum()), (1 - rate) / max(1, (y == 0).sum()))
    coef, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 0.3 / len(y))  # few texts say little about a slope
    ridge[0] = 1e-9
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * coef)
        coef += np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    model.coef, model.mean, model.scale, model.base = coef, mean, scale, rate
    return model


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, per_class: int) -> tuple[list[str], list[int], float]:
    """Texts, labels and natural rate of label 1 of the rows to learn from: a hash sample of each class."""
    y = labels.where(fold_of(F.col("doc_id"), folds) != held_out).where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("__y"))
    counts = {r[0]: r[1] for r in y.groupBy("__y").count().collect()}
    ids = F.broadcast(class_sample(y, "__y", per_class).withColumnRenamed("doc_id", "__d"))  # bounded by per_class
    got = docs.join(ids, F.col("doc_id") == F.col("__d")).select(F.coalesce("text", F.lit("")), "__y", "doc_id").collect()
    got.sort(key=lambda r: (r[2], r[0]))
    return [r[0] for r in got], [r[1] for r in got], counts.get(1, 0) / max(1, sum(counts.values()))


def joined_batches(batches, rows: int = 500_000):
    """Tables of about ``rows`` rows from Arrow batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def by_text(docs: DataFrame, model: Broadcast, of, kind: str) -> DataFrame:
    """doc_id and what ``of`` (model, texts) tells of every row: a list for each block of texts."""
    as_table = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind]

    def run(batches):
        for batch in small_batches(batches, 1):
            yield pa.record_batch([batch.column(0), pa.array(of(model.value, batch.column(1).to_pylist()), as_table)], names=["doc_id", "got"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, got {kind}")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return by_text(docs, shared, lambda m, texts: m.scores(texts), "double").withColumnRenamed("got", "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned outside fold 2 of 4."""
    with shuffles_freed(docs.sparkSession):
        model = fit(docs, labels)
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
