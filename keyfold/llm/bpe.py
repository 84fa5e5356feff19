"""BPE encoding and decoding by prefix-sharing trie traversal.

The vocabulary is a published one with word ends ("</w>"), lower case and
dropped white space; it is only read, never trained.

For every prefix of a word the last token of the prefix's encoding is enough
to rebuild the whole encoding: what stands before that token is the encoding
of the shorter prefix. So the distinct words of a block of texts form a trie,
a traversal gives each trie node its last token, and a prefix that many
words share is encoded once. The trie is held as its sorted word list with the
lengths of shared prefixes, its nodes in depth-first order; states pass from
parents to children, all nodes of one depth in one array operation, and a long
word's path node by node. An automaton over the tokens' strings names the
tokens that end at each node, so a node costs a few look-ups whatever its
depth. A block's chunks between white space are cut and numbered by array
operations; ids of distinct chunks are remembered, as long as they are few and
short enough.

Edge cases: a null or empty text has no ids and decodes to the empty text;
white space alone has no ids; the special tokens' own strings in a text become
their ids, as the tokenizers library does; a repeated or null doc_id is
passed through row by row.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import small_batches, text_blocks

#: Chunks whose ids an encoder remembers in each of two generations, and a quarter of the token pairs.
REMEMBERED = 100_000
#: Bytes of the longest chunk that is remembered.
LONG = 64
#: Bytes of the longest word whose trie nodes are worked out by array operations.
WIDE = 40
#: Characters that are encoded at once, unless one text is longer.
BLOCK = 1_000_000
#: A rank after all merges.
NEVER = 1 << 60
#: White space as Unicode defines it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words as the vocabulary's file splits them, from any text in lower case, and the ends of lines between them.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+|\n")
#: The same for texts of characters below U+0250 only, whose letters and numbers are these ranges.
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^{_SPACE}a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ0-9\xb2\xb3\xb9\xbc-\xbe]+|\n")
_BEYOND_LATIN = re.compile(r"[^\0-ɏ]|[A-Z\xc0-\xd6\xd8-\xde]")
#: Classes of UTF-8 bytes: 1 for white space, 2 for a byte that may begin it, 0 for others.
_CLASSES = bytes(1 if 9 <= b <= 13 or b == 32 else 2 * (b in b"\xc2\xe1\xe2\xe3") for b in range(256))
#: White space of more than one byte, as numbers of three bytes.
_WIDE_SPACES = np.array(sorted(int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{_SPACE}]", c)))


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def normal(text: str, lower: tuple[re.Pattern, dict[int, str]] | None = None) -> str:
    """Composed form, each character in lower case by itself, as ``lower`` has it if it does. White space needs no change: words leave it out."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        if lower and lower[0].search(text):
            text = text.translate(lower[1])
    return text.lower()


def outside_space(data: bytes) -> np.ndarray:
    """Whether each byte of UTF-8 text, which ends with a line, belongs to no white space."""
    classes = np.frombuffer(data.translate(_CLASSES), np.uint8)
    out = classes != 1
    at = np.flatnonzero(classes == 2)
    if len(at):
        raw = np.frombuffer(data, np.uint8)
        lead = raw[at].astype(np.int64)
        code = lead << 16 | raw[at + 1].astype(np.int64) << 8 | np.where(lead == 0xC2, 0, raw[at + 2])
        hit = np.isin(code, _WIDE_SPACES)
        at, long = at[hit], at[hit & (lead != 0xC2)]
        out[at] = out[at + 1] = out[long + 2] = False
    return out


@lru_cache(maxsize=1)
def differing_classes() -> tuple[tuple[str, str], ...]:
    """(class, characters as ranges of a set) of the code points that the tokenizers library takes for letters (L), numbers (N) or neither (O) and ``_WORDS`` does not; and, as "lower", lines of characters and their other lower case there.

    The two know different versions of Unicode. The library is asked once, with
    all code points that are alike here in one text: where they are alike there
    too it gives one piece for all (for numbers one each).
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    ask = pre_tokenizers.Split(Regex(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True).pre_tokenize_str
    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    found: dict[str, list[int]] = {"L": [], "N": [], "O": []}
    for kind, pattern in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("O", rf"[^{_SPACE}\p{{L}}\p{{N}}]+")):
        for piece, _ in ask("".join(regex.findall(pattern, everything))):
            there = "L" if len(ask("a" + piece[0])) == 1 else "O" if len(ask("!" + piece[0])) == 1 else "N"
            if there != kind:
                found[there] += map(ord, piece)
    lines = everything.replace("\n", "")
    pairs = zip(lines, normalizers.Lowercase().normalize_str("\n".join(lines)).split("\n"))
    lower = "\n".join(c + there for c, there in pairs if c.lower() != there)
    return tuple((kind, _ranges(sorted(codes))) for kind, codes in found.items() if codes) + ((("lower", lower),) if lower else ())


def _ranges(codes: list[int]) -> str:
    """Sorted code points as ranges of a regular expression's set."""
    starts = [c for before, c in zip([-2, *codes], codes) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if after != c + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))


def own_words(classes: tuple[tuple[str, str], ...]) -> tuple[re.Pattern, regex.Pattern] | None:
    """A search for characters of ``classes``, and ``_WORDS`` as it is with them."""
    of = {kind: ranges for kind, ranges in classes if kind != "lower"}
    if not of:
        return None
    every = "".join(of.values())
    letters, numbers = (rf"[\p{{{k}}}--[{every}]]" + (f"||[{of[k]}]" if k in of else "") for k in "LN")
    rest = rf"[^{_SPACE}\p{{L}}\p{{N}}{every}]" + (f"||[{of['O']}]" if "O" in of else "")
    return re.compile(f"[{every}]"), regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{rest}]+|\n", regex.V1)


def split_words(lines: str, own: tuple[re.Pattern, regex.Pattern] | None = None) -> tuple[list[str], str, list[str]]:
    """Lines of normalised text that are one word each, the others, and the words of these, with a line's end after each line's. Lines that ``own`` finds are split by it."""
    if not _BEYOND_LATIN.search(lines):
        latin, others = lines.split("\n"), []
    else:
        latin, others = [], []
        for line in lines.split("\n"):
            (others if _BEYOND_LATIN.search(line) else latin).append(line)
    alone = [line for line in latin if line.isalpha()]
    latin = [line for line in latin if not line.isalpha()]
    odd = []
    if own and others:
        odd = [line for line in others if own[0].search(line)]
        others = [line for line in others if not own[0].search(line)] if odd else others
    words = []
    for part, find in ((latin, _LATIN_WORDS.findall), (others, _WORDS.findall), (odd, own and own[1].findall)):
        if part:
            words += find("\n".join(part))
            words.append("\n")
    return alone, "\n".join(latin + others + odd), words


def gather(runs: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the runs that ``which`` names, one after another, and where each of them ends."""
    size = np.fromiter(map(len, runs), np.int64, len(runs)) >> 2
    n = size[which]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(size) - size)[which] - ends + n, n)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(runs), "<u4")[at], ends


class Numbers:
    """Numbers by numbers of at least 0, looked up and put in by arrays (open addressing, at most half full)."""

    def __init__(self, most: int):
        self.most, self.n, self.bits = most, 0, (2 * most).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 without one."""
        slot, mask = self._slots(keys), (1 << self.bits) - 1
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = at = slot[open_] + 1 & mask
            found, hit = self.keys[at], self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct keys that are not in yet; a full table forgets what it had."""
        keys, values = keys[: self.most], values[: self.most]
        if self.n + len(keys) > self.most:
            self.keys.fill(-1)
            self.n = 0
        self.n += len(keys)
        slot, open_, mask = self._slots(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(open_):
            free = open_[self.keys[slot[open_]] < 0]
            self.keys[slot[free]] = keys[free]  # of several keys one stays
            won = self.keys[slot[open_]] == keys[open_]
            self.values[slot[open_[won]]] = values[open_[won]]
            open_ = open_[~won]
            slot[open_] = slot[open_] + 1 & mask


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, remembered: int | None = None, classes: tuple[tuple[str, str], ...] | None = None):
        self.remembered = remembered or REMEMBERED
        classes = differing_classes() if classes is None else classes
        self.own = own_words(classes)
        lower = {ord(line[0]): line[1:] for line in dict(classes).get("lower", "").split("\n") if line}
        self.lower = (re.compile(f"[{_ranges(sorted(lower))}]"), lower) if lower else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or spec["decoder"] or spec["post_processor"]:
            raise ValueError("a BPE vocabulary with word ends and no decoder is needed")
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.names: dict[int, bytes] = {i: s.encode() for s, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        byte_of = {c: b for b, c in byte_symbols().items()}
        #: When a token comes into being: bytes at -1, others by their merge's rank.
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.joined.setdefault(left << 20 | right, rank)
            if made not in self.parts:
                self.parts[made] = (left, right)
                self.born[made] = rank
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for s, i in vocab.items():
            ends = s.endswith("</w>") and s != "</w>"
            body = s[:-4] if ends else s
            if i in self.specials.values() or any(c not in byte_of for c in body):
                continue
            if i not in self.parts:
                if len(body) > 1:
                    continue
                self.born[i] = -1
            (self.final if ends else self.inner)[bytes(byte_of[c] for c in body)] = i
        self.inner = {k: i for k, i in self.inner.items() if self._stable(i)}
        self.final = {k: i for k, i in self.final.items() if self._stable(i)}
        self._automaton()
        size = max(self.names) + 1
        self.births, self.sides = np.full(size, -1, np.int64), np.full((2, size), -1, np.int64)
        self.births[list(self.born)] = list(self.born.values())
        self.sides[:, list(self.parts)] = np.array(list(self.parts.values()), np.int64).reshape(-1, 2).T
        self.ranks = Numbers(len(self.joined))
        self.ranks.put(np.array(list(self.joined), np.int64), np.array(list(self.joined.values()), np.int64))
        self.tried = Numbers(4 * self.remembered)
        self.mark_of = {c: b"\xff%d" % i for c, i in self.specials.items()}  # no UTF-8 text has this byte
        self.marks = {self.mark_of[c]: struct.pack("<I", i) for c, i in self.specials.items()}
        self.pairs: dict[int, bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _automaton(self) -> None:
        """States for the tokens' prefixes: a state is the longest end of what was read that begins a token.

        ``inner`` and ``final`` hold, for each state: the longest token that
        ends there, as the state of its own string (0 if there is none); that
        token; and the state of the next shorter token that ends there.
        """
        go: dict[int, int] = {}
        parent, byte, named = [0], [0], ({}, {})
        for at_end, tokens in zip(named, (self.inner, self.final)):
            for name, token in tokens.items():
                at = 0
                for b in name:
                    to = go.get(at << 8 | b)
                    if to is None:
                        to = go[at << 8 | b] = len(parent)
                        parent.append(at)
                        byte.append(b)
                    at = to
                at_end[at] = token
        n = len(parent)
        depth, back = [0] * n, [0] * n
        for k in range(1, n):  # a state's parent has a smaller number
            depth[k] = depth[parent[k]] + 1
        tables = [([0] * n, [0] * n, [0] * n) for _ in named]
        for k in sorted(range(1, n), key=depth.__getitem__):
            if parent[k]:
                at = back[parent[k]]
                while at and at << 8 | byte[k] not in go:
                    at = back[at]
                back[k] = go.get(at << 8 | byte[k], 0)
            for at_end, (first, token, after) in zip(named, tables):
                after[k] = first[back[k]]
                first[k] = k if k in at_end else after[k]
                token[k] = at_end.get(k, 0)
        self.go, self.back, self.depth, (self.inner_ends, self.final_ends) = go, back, depth, tables
        self.steps = Numbers(len(go))
        self.steps.put(np.array(list(go), np.int64), np.array(list(go.values()), np.int64))
        self.arrays = np.array(back, np.int64), np.array(depth, np.int64), *[np.array(t, np.int64) for t in tables]

    def _edges(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Tokens that stand at one edge of ``token`` over time: (token, rank at which it arises, rank at which it is taken up)."""
        found = self.edges[side].get(token)
        if found is None:
            found, at, gone = [], token, NEVER
            while True:
                found.append((at, self.born[at], gone))
                if at not in self.parts:
                    break
                gone, at = self.born[at], self.parts[at][side]
            self.edges[side][token] = found
        return found

    def _apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge ranked below ``until`` crosses from ``left`` to ``right`` while both are built.

        Equal ranks go from left to right: a crossing pair loses to the same
        pair further left, and wins over the same pair further right.
        """
        joined, rights = self.joined, self._edges(right, 0)
        for a, a_born, a_gone in self._edges(left, 1):
            for b, b_born, b_gone in rights:
                if b_gone < a_born:
                    break
                if b_born < a_gone:
                    rank = joined.get(a << 20 | b)
                    if rank is not None and b_born < rank > a_born and rank < a_gone and rank <= b_gone and rank < until:
                        return False
        return True

    @lru_cache(maxsize=None)  # noqa: B019
    def _stable(self, token: int) -> bool:
        """Whether a token's own string is encoded as this token alone."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return left in self.born and right in self.born and self._stable(left) and self._stable(right) and self._apart(left, right, self.born[token])

    def _fits(self, key: int) -> bool:
        """Whether the token in the low 20 bits of ``key`` may follow the one above them."""
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self._apart(key >> 20, key & 0xFFFFF)
        return found

    def _all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_apart`` of many pairs: the tokens at the edges of both sides are met from the whole token inwards, all pairs at once."""
        out = np.ones(len(left), bool)
        pair, a, a_gone = np.arange(len(left)), left, np.full(len(left), NEVER)
        while len(pair):
            a_born = self.births[a]
            at, b, b_gone = np.arange(len(pair)), right[pair], np.full(len(pair), NEVER)
            while len(at):
                b_born, rank = self.births[b], self.ranks.get(a[at] << 20 | b)
                out[pair[at[(rank > b_born) & (rank > a_born[at]) & (rank < a_gone[at]) & (rank <= b_gone)]]] = False
                b = self.sides[0][b]
                on = (b >= 0) & (b_born >= a_born[at]) & out[pair[at]]
                at, b, b_gone = at[on], b[on], b_born[on]
            a = self.sides[1][a]
            on = (a >= 0) & out[pair]
            pair, a, a_gone = pair[on], a[on], a_born[on]
        return out

    def _all_fit(self, keys: np.ndarray) -> np.ndarray:
        """``_fits`` of many keys."""
        found = self.tried.get(keys)
        open_ = np.flatnonzero(found < 0)
        if len(open_):
            new, which = np.unique(keys[open_], return_inverse=True)
            apart = self._all_apart(new >> 20, new & 0xFFFFF)
            self.tried.put(new, apart)
            found[open_] = apart[which]
        return found > 0

    def learn(self, words: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        """Distinct words with their ids, by their trie; time and memory are linear in the words' bytes."""
        if len(self.pairs) > 4 * self.remembered:
            self.pairs.clear()
        order = sorted(words)  # the trie in depth-first order
        short = [w for w in order if len(w) <= WIDE]
        return chain(zip(short, self._levels(short)), ((w, self._walk(w)) for w in order if len(w) > WIDE))

    def _walk(self, word: bytes) -> bytes:
        """Ids of one long word: its path from the root, a node at a time."""
        go, back, depth = self.go, self.back, self.depth
        last, lengths, auto = [0], [0], 0
        for n, byte in enumerate(word, 1):
            while auto and auto << 8 | byte not in go:
                auto = back[auto]
            auto = go.get(auto << 8 | byte, 0)
            first, token, after = self.inner_ends if n < len(word) else self.final_ends
            end = first[auto]
            while depth[end] < n and not self._fits(last[n - depth[end]] << 20 | token[end]):
                end = after[end]
            last.append(token[end])
            lengths.append(depth[end])
        ids, at = array("I"), len(word)
        while at:
            ids.append(last[at])
            at -= lengths[at]
        ids.reverse()
        return ids.tobytes()

    def _levels(self, words: list[bytes]) -> list[bytes]:
        """Ids of sorted words of at most ``WIDE`` bytes: the nodes of their trie, from parents to children, a depth at a time."""
        if not words:
            return []
        n = len(words)
        back, depth, inner, final = self.arrays
        size = np.fromiter(map(len, words), np.int64, n)
        heads = np.zeros((n, WIDE), np.uint8)
        heads[np.arange(WIDE) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        other = np.ones((n, WIDE + 1), bool)
        other[1:, :WIDE] = heads[1:] != heads[:-1]
        shared = other.argmax(axis=1)
        shared[1:] = np.minimum(shared[1:], size[:-1] - 1)
        shared[0] = 0
        last, lengths = np.zeros((WIDE + 1, n), np.int64), np.zeros((WIDE + 1, n), np.int64)
        autos, every = np.zeros(n, np.int64), np.arange(n)

        def step(rows: np.ndarray, d: int) -> np.ndarray:
            at, byte = autos[rows], heads[rows, d - 1].astype(np.int64)
            out, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
            while len(open_):
                to = self.steps.get(at[open_] << 8 | byte[open_])
                out[open_] = np.maximum(to, 0)
                open_ = open_[(to < 0) & (at[open_] > 0)]
                at[open_] = back[at[open_]]
            return out

        def choose(rows: np.ndarray, state: np.ndarray, d: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The last token of each row at depth d, and its length: the longest that may follow what stands before it."""
            end, open_ = table[0][state], np.arange(len(rows))
            while True:
                open_ = open_[depth[end[open_]] < d]
                if not len(open_):
                    return table[1][end], depth[end]
                open_ = open_[~self._all_fit(last[d - depth[end[open_]], rows[open_]] << 20 | table[1][end[open_]])]
                end[open_] = table[2][end[open_]]

        live = every
        for d in range(1, int(size.max()) + 1):
            live = live[size[live] >= d]
            stops = size[live] == d
            rows, live = live[stops], live[~stops]
            last[d, rows], lengths[d, rows] = choose(rows, step(rows, d), d, final)
            new = shared[live] < d
            rows = live[new]
            state = step(rows, d)
            token, length = choose(rows, state, d, inner)
            # A node that several words share is worked out at the first of them.
            from_ = np.cumsum(new) - 1
            autos[live], last[d, live], lengths[d, live] = state[from_], token[from_], length[from_]
        parts, owners, at, rows = [], [], size.copy(), every
        while len(rows):
            parts.append(last[at[rows], rows])
            owners.append(rows)
            at[rows] -= lengths[at[rows], rows]
            rows = rows[at[rows] > 0]
        # Tokens were met from the last to the first.
        flat = np.concatenate(parts[::-1])[np.argsort(np.concatenate(owners[::-1]), kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(np.concatenate(owners), minlength=n) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _plain(self, text: str | None) -> bytes:
        """A text's normal form, with a mark where a special token's string stands."""
        if not text:
            return b""
        if self.cut_specials is None or "<|" not in text:
            return normal(text, self.lower).encode()
        return b" ".join([self.mark_of[p] if p in self.specials else normal(p, self.lower).encode() for p in self.cut_specials.split(text)])

    def _chunks(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct chunks between white space, which of them stand in the texts, in order, and how many of these stand before each text's end.

        Words never cross white space, so a chunk's ids are those of its words.
        """
        parts = [self._plain(t) for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts])
        data = b"\n" + b"\n".join(parts) + b"\n"
        del parts
        inside = outside_space(data)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        body = np.frombuffer(data, np.uint8)[inside]
        found = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        distinct, which = found.dictionary, np.frombuffer(found.indices.buffers()[1], np.int32, len(sizes))
        raw, cuts = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])], which, np.searchsorted(starts, ends)

    def _look_up(self, chunks: list[bytes]) -> set[bytes]:
        """Bring the ids of all of ``chunks``, and of the words of new ones, into ``known``; returns the long ones, which are not to stay."""
        seen = set(chunks)
        new = seen.difference(self.known)
        if new and self.known and len(self.known) + len(new) > self.remembered:  # what is met again outlives its generation
            self.older, self.known, new = self.known, {}, seen
        known, older = self.known, self.older
        known |= {c: self.marks[c] for c in new & self.marks.keys()}
        again = new & older.keys()
        known.update(zip(again, map(older.__getitem__, again)))
        new = new.difference(known)
        if not new:
            return set()
        alone, lines, split = split_words(b"\n".join(new).decode(), self.own)
        parts = set(split)
        parts.discard("\n")
        words = list(parts.union(alone))
        coded = "\n".join(words).encode().split(b"\n")
        again = older.keys() & coded
        known.update(zip(again, map(older.__getitem__, again)))
        known.update(self.learn([w for w in coded if w not in known]))
        if not split:
            return {w for w in coded if len(w) > LONG}
        words = list(parts)
        coded_parts = "\n".join(words).encode().split(b"\n")
        place = dict(zip([*words, "\n"], range(len(words) + 1)))
        which = np.fromiter(map(place.__getitem__, split), np.int64, len(split))
        ids, ends = gather([*map(known.__getitem__, coded_parts), b""], which)
        raw, ends = ids.tobytes(), (4 * ends[which == len(words)]).tolist()
        new = lines.encode().split(b"\n")
        known |= {c: raw[a:b] for c, a, b in zip(new, [0, *ends], ends)}
        return {c for c in chain(new, coded) if len(c) > LONG}

    def encode(self, texts: list[str | None], block: int | None = None):
        """Ids of each text as little-endian unsigned 32-bit integers, in order."""
        for start, end in text_blocks(texts, block or BLOCK):
            chunks, which, counts = self._chunks(texts[start:end])
            long = self._look_up(chunks)
            ids, ends = gather([*map(self.known.__getitem__, chunks)], which)
            for c in long:
                del self.known[c]
            ends = np.concatenate([[0], ends])[counts].tolist()
            del chunks, which, counts
            for a, b in zip([0, *ends], ends):
                yield ids[a:b].tobytes()

    def decode(self, ids) -> bytes:
        """UTF-8 text of ids: their tokens' strings, parted by single spaces."""
        return b" ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, remembered: int | None = None, classes: tuple[tuple[str, str], ...] | None = None) -> WordBpe:
    """One encoder for a Python worker; ``classes`` as the driver found them (``differing_classes``)."""
    made = WordBpe(path, remembered, classes)
    gc.freeze()  # the vocabulary stays; the collector need not look through it again
    return made


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian u32), decoded (string) of each row; no shuffle."""

    classes = differing_classes()

    def run(batches):
        bpe = load(path, classes=classes)
        for batch in small_batches(batches, 1, BLOCK):
            ids = list(bpe.encode(batch.column(1).to_pylist()))
            out = [bpe.decode(memoryview(x).cast("I")) for x in ids]
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_decode gives, hashed where it is made."""

    classes = differing_classes()

    def run(batches):
        bpe = load(path, classes=classes)
        for batch in small_batches(batches, 1, BLOCK):
            counts, first, second = [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                first.append(sha256(ids).hexdigest())
                second.append(sha256(bpe.decode(memoryview(ids).cast("I"))).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
