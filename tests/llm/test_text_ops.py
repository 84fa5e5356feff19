import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import bpe, chat, decontam, license_scan, token_store

P = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello world's BIG day", None, "", " \t\n ", "été ÀÉ naïve", "ΑΣ ΑΣΑ İstanbul", "<|endoftext|>after<|startoftext|> <|x", "aaaaaaaaaaaaaaa hahahahaha !!!!!!!!", "漢字 かな 한국 😀👍🏽", "１２ ½ ²³ 10 000", "don't we'll I'M you're", "x" * 30_000, "word " * 5_000]


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    return t


def library(text):
    t = tokenizer()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def more_texts(n=3000):
    rng = random.Random(3)
    letters = "aAbBeéÉßΣσςİıſ 's't're'll'd 12½²\t\n\x0b\x1c\x85\xa0　'’“!?-_/漢か한😀́‍<|"
    stems = "the quick brown international understanding photographers congratulations ation ing".split()
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["".join(rng.choice(stems)[: rng.randint(1, 9)] for _ in range(rng.randint(1, 6))) for _ in range(n)]


def test_bpe_equals_the_library():
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    texts = TEXTS + more_texts()
    for text, raw in zip(texts, coder.encode(texts)):
        ids, decoded = library(text)
        assert list(memoryview(raw).cast("I")) == ids, text
        assert coder.decode(ids).decode() == decoded


def test_bpe_words_of_any_length():
    """Words around the width of the array operations, with shared prefixes, separators, zero bytes and every script."""
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    rng = random.Random(9)
    stem = "".join(rng.choice("abcdeéß漢") for _ in range(200))
    texts = [stem[:n] + tail for n in range(20, 60) for tail in ("", "x", "ing", "é", "\0", "\0\0")] + [stem[:100] + c for c in "abc"]
    texts += ["a\x1cb c\x1d!\x1e", "\x1f", "\0", "a\0 a\0\0 a", "x" * 39 + " " + "x" * 40 + " " + "x" * 41 + " " + "x" * 42]
    for text, raw in zip(texts, coder.encode(texts)):
        assert list(memoryview(raw).cast("I")) == library(text)[0], text
    assert max(map(len, coder.known)) <= bpe.LONG


def test_bpe_of_one_very_long_word_is_linear():
    """A million letters without white space: ids as the library's, in a process that grows by less than 500 MB."""
    import resource

    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    rng = random.Random(4)
    word = "".join(rng.choice("acgtacgtnhe") for _ in range(1_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    raw = next(coder.encode([word]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert list(memoryview(raw).cast("I")) == library(word)[0]


def test_bpe_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    texts = more_texts(300)
    for _ in range(2):
        for text in texts:
            assert list(memoryview(next(coder.encode([text]))).cast("I")) == library(text)[0]
    assert len(coder.older) <= 50 + 60


def test_bpe_looks_through_a_block_at_once(monkeypatch):
    """Which words may be split the short way is asked once a block, not once a chunk; chunks met before ask nothing."""
    asked, real = [], bpe._BEYOND_LATIN
    monkeypatch.setattr(bpe, "_BEYOND_LATIN", type("Counted", (), {"search": staticmethod(lambda text: asked.append(text) or real.search(text))}))
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    for block in (["one two three, four's", "two 5six"], ["seven two", "eight!"], ["three, two one"], [None, ""]):
        for text, raw in zip(block, coder.encode(block), strict=True):
            assert list(memoryview(raw).cast("I")) == library(text or "")[0]
    assert len(asked) == 2


def test_bpe_weighs_pairs_of_tokens_all_at_once(monkeypatch):
    """Words of usual length ask for no pair of tokens by itself, and pairs asked for together get what each gets by itself."""
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    rng = random.Random(5)
    tokens = list(coder.inner.values())
    pairs = sorted({rng.choice(tokens) << 20 | rng.choice(tokens) for _ in range(20_000)} | {a << 20 | b for a, b in list(coder.parts.values())[:5_000] if a in coder.born and b in coder.born})
    single = [coder._fits(k) for k in pairs]
    assert 0 < sum(single) < len(single)
    for _ in range(2):  # found out, then remembered
        assert coder._all_fit(np.array(pairs)).tolist() == single
    asked = []
    monkeypatch.setattr(coder, "_fits", asked.append)
    texts = ["a photographer's internationalisation, été 12!", "ΑΣΑ 漢字かな naïve", "don't <|endoftext|> we'll"]
    assert [list(memoryview(raw).cast("I")) for raw in coder.encode(texts)] == [library(t)[0] for t in texts] and not asked


def test_numbers_by_numbers():
    table, rng = bpe.Numbers(1000), np.random.default_rng(6)
    keys = rng.permutation(5000)[:900] << 7
    table.put(keys[:500], keys[:500] + 1)
    table.put(keys[500:], keys[500:] + 1)
    assert (table.get(keys) == keys + 1).all() and (table.get(keys + 1) == -1).all()
    table.put(np.arange(1, 1500), np.arange(1, 1500))  # more than it holds: what was there is forgotten, and the last ones are not kept
    assert (table.get(np.arange(1, 1001)) == np.arange(1, 1001)).all() and (table.get(np.arange(1001, 1500)) == -1).all()


def test_bpe_white_space_of_every_width():
    """Each white space, and each character beside it in code, parts chunks as the library does, at both ends of a text and next to special tokens."""
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    codes = [*range(0xA2), 0x167F, 0x1680, 0x1681, *range(0x1FFF, 0x2070), 0x2FFF, 0x3000, 0x3001, 0x180E, 0xFEFF, 0xC2, 0xE1, 0xE2, 0xE3]
    texts = [f"{c}one{c}{c}two's 3{c}<|endoftext|>{c}é{c}" for c in map(chr, codes)]
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        assert list(memoryview(raw).cast("I")) == library(text)[0], text


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int").repartition(3)


def test_bpe_query_columns(spark):
    got = {r.doc_id: r for r in bpe.digests(docs_of(spark, TEXTS), P.path("word_bpe_49k.json")).collect()}
    full = {r.doc_id: r for r in bpe.encode_decode(docs_of(spark, TEXTS), P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(TEXTS):
        ids, decoded = library(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == sha256(decoded.encode()).hexdigest() and full[i].decoded == decoded
    assert bpe.digests(docs_of(spark, []), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        planes = token_store.to_planes(ids, bits)
        assert len(planes) == (32 if bits else 4) and (token_store.from_planes(planes, n) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_shard_file(tmp_path, bits):
    import pyarrow.fs as pafs

    rng = np.random.default_rng(2)
    docs = [(k if k else None, rng.integers(0, 60_000, n).astype("<u4")) for k, n in enumerate([3, 0, 1000, 64, 1, 5000, 0])]
    with (tmp_path / "s").open("wb") as f:
        w = token_store.ShardWriter(f, 64, bits)
        for d in docs:
            w.add(*d)
        w.close()
    r = token_store.ShardReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "s")))
    at = 0
    for (doc_id, ids), (d, start, got) in zip(docs, r.documents(), strict=True):
        assert (d, start) == (doc_id, at) and (got == ids).all() and (r.ids(at, at + len(ids)) == ids).all()
        at += len(ids)
    (tmp_path / "s").write_bytes((tmp_path / "s").read_bytes()[:-3])
    with pytest.raises(ValueError):
        token_store.ShardReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "s")))


def test_store_matches_the_library(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, base int").orderBy(F.rand(1)).repartition(5)
    got = sorted(tuple(r) for r in token_store.store(docs, P.path("word_bpe_49k.json")).collect())
    at, expected = 0, []
    for i, t in sorted(rows):
        ids = [*library(t)[0], 1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    assert token_store.store(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def shingles(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(n, len(w)) if w else 1
    return n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def runs(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    lexicon = [f"v{k}" for k in range(300)]
    say = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([5, 9, 30, 60])))) for k in range(20)] + [(20, "short item"), (21, ""), (22, None), (23, "!?"), (24, "short item")]
    docs = []
    for k in range(120):
        w = say(rng.choice([3, 50, 4000]))
        item = rng.choice(items)[1]
        if item and rng.random() < 0.7:
            part = item.upper().split()
            part = part[: max(1, int(len(part) * rng.choice([1, 1, 0.9, 0.6])))]
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((k, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "a short item, here"), (502, "a short item, here"), (None, "Short ITEM")]
    expected = {}
    for i, t in docs:
        for j, s in items:
            n, want = shingles(s)
            if want and len(want & runs(t, n)) >= 0.8 * len(want) - 1e-9:
                expected[i, j] = (len(want), len(want & runs(t, n)))
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").drop("item_id").withColumn("h", F.lit(1)).repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, w string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontam.contaminated(d, b).collect()}
    assert got == expected and len(expected) > 20
    clean = {r.doc_id for r in decontam.decontaminate(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in expected}
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.decontaminate(d, b.limit(0)).count() == len(docs)
    assert decontam.contaminated(d.limit(0), b).count() == 0


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (3, None, None, "who"), (3, 5, "ann", "x"), (3, 5, "ann", "x"), (None, 1, "ann", "n")]
    rows += [(9, k, "ann" if k % 3 else "bob", f"t{k}") for k in range(700)]
    t = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, position int").repartition(4)
    got = {}
    for r in chat.rotate(t, block=64).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "ann"), (3, "unknown"), (None, "ann"), (9, "ann"), (9, "bob")}
    for (conv, who), ms in got.items():
        ms.sort(key=lambda r: r.position)
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "unknown", r[3] or ""))
        assert [m.position for m in ms] == list(range(len(turns)))
        text = "".join(m.message for m in ms)
        for m, (_, turn, role, said) in zip(ms, turns):
            role = role or "unknown"
            head = "assistant" if role == who else "system" if role == "system" else f"user name={role}"
            assert m.turn == turn and text[m.start : m.end] == m.message == f"<|im_start|>{head}\n{said or ''}<|im_end|>\n"
            assert (m.mask_start is None) == (role != who)
            if role == who:
                assert text[m.mask_start : m.mask_end] == f"{said or ''}<|im_end|>\n"
    assert chat.rotate(t.limit(0)).count() == 0


def test_license_scan(spark):
    m = license_scan.Matcher()
    files = [(1, "a/LICENSE", "Title\nReleased under the MIT License."), (2, "a/b/c/x.py", "nothing here"), (3, "a/b/LICENSE", "no licence words"), (4, "a/b/y.py", "# Licensed under the Apache License, Version 2.0\ncode = mit"), (5, "top.txt", None), (6, "a2/z.py", ""), (7, None, "This work is licensed under the GNU General Public License, version 3."), (8, "q/COPYING", "Licensed under CC BY-NC 4.0."), (9, "q/LICENSE.txt", "x\r\nLicensed under CC BY-NC 4.0."), (10, "q/r/s/t.c", "text " * 20_000), (10, "q/r/s/t.c", "mit mit mit")]
    df = spark.createDataFrame([(*r, "z") for r in files], "doc_id long, path string, text string, dir string").repartition(3)
    got = Counter((r.doc_id, r.own_licence, r.licence, r.origin) for r in license_scan.scan(df).collect())
    assert got == Counter([(1, "MIT", "MIT", "own"), (2, None, "MIT", "a"), (3, None, "MIT", "a"), (4, "Apache-2.0", "Apache-2.0", "own"), (5, None, None, None), (6, None, None, None), (7, "GPL-3.0", "GPL-3.0", "own"), (8, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "own"), (9, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "own"), (10, None, "CC-BY-NC-4.0", "q"), (10, None, "CC-BY-NC-4.0", "q")])
    assert license_scan.scan(df.limit(0)).count() == 0
    rng = random.Random(6)
    vocabulary = [*m.idf, "other", "words", "été"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [" ".join(t.split()[: rng.randint(2, 30)] + rng.choice([[], ["more"]])) for _, t in license_scan.TEMPLATES for _ in range(10)]
    own = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").select("doc_id", m.best_line(F.col("text")).alias("own"))
    passed = 0
    for r in own.collect():
        best, name = m.cosine(lines[r.doc_id])
        assert (r.own is not None) == (best >= m.threshold - 1e-9), lines[r.doc_id]
        if r.own:
            passed += 1
            assert abs(r.own.score - best) < 1e-6 and (r.own.licence == name or abs(best - r.own.score) < 1e-6)
    assert passed > 30


def test_license_paths_let_ancestors_decide(spark):
    """In the query's tree, directories hold several files and licences come from the own directory and from higher ones."""
    line = "Released under the MIT License."
    rows = [(i, line if i % 7 == 0 else "words", "en" if i % 3 else None, f"src{i % 20}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("path", license_scan.file_path())
    got = license_scan.scan(docs).collect()
    home = {r.doc_id: r.path.rsplit("/", 1)[0] for r in got}
    assert len(got) == 3000 and max(Counter(home.values()).values()) > 2
    gives = {home[r.doc_id] for r in got if "/LICENSE" in r.path and r.own_licence}
    for r in got:
        parts = home[r.doc_id].split("/")
        near = next((d for n in range(len(parts), 0, -1) if (d := "/".join(parts[:n])) in gives), None)
        assert r.origin == ("own" if r.own_licence else near)
    depths = Counter(r.origin.count("/") for r in got if r.origin not in (None, "own") and r.origin != home[r.doc_id])
    assert {0, 1, 2} <= set(depths)
    assert any(r.origin == home[r.doc_id] for r in got)


def licences_of(spark, texts):
    m = license_scan.Matcher()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.own for r in df.select("doc_id", m.best_line(F.col("text")).alias("own")).collect()}
    for i, t in enumerate(texts):
        best, name = m.cosine(t)
        assert (got[i].licence if got[i] else None) == name and (not got[i] or abs(got[i].score - best) < 1e-6), t
    return [got[i].licence if got[i] else None for i in range(len(texts))]


def test_license_neighbouring_words_and_whole_texts(spark):
    """Words on the same line, line breaks and whole texts hide no licence; "All rights reserved." is one, the weakest."""
    mit, bsd2, bsd3 = license_scan.WHOLE[3][1], license_scan.WHOLE[0][1], license_scan.WHOLE[1][1]
    cases = [
        ("All rights reserved.", "LicenseRef-Proprietary"),
        ("x\nCopyright 2020 Foo. All rights reserved.\nmore", "LicenseRef-Proprietary"),
        ("Released under the MIT License. Copyright 2020 Foo Bar", "MIT"),
        ("Copyright Foo. All rights reserved. Released under the MIT Licence.", "MIT"),
        ("This work is licensed under the GNU General Public License, version 3. Another sentence stands here on the same line.", "GPL-3.0"),
        ("words before GNU General\n   Public License,\nversion 3 and words after", "GPL-3.0"),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nAll rights reserved.", "MIT OR Apache-2.0"),
        (mit.replace("\n", " "), "MIT"),
        (mit, "MIT"),
        (bsd2, "BSD-2-Clause"),
        ("All rights reserved.\n" + bsd3, "BSD-3-Clause"),
        ("no rights, no words", None),
        ("mit der Licence", None),
    ]
    assert licences_of(spark, [t for t, _ in cases]) == [n for _, n in cases]
    files = spark.createDataFrame([(1, "a/LICENSE", "MIT License"), (2, "a/b.py", "All rights reserved."), (3, "a/c.py", "")], "doc_id long, path string, text string")
    assert {r.doc_id: (r.licence, r.origin) for r in license_scan.scan(files).collect()} == {1: ("MIT", "own"), 2: ("LicenseRef-Proprietary", "own"), 3: ("MIT", "a")}


def test_license_siblings_are_told_apart(spark):
    """A short form is not taken for a sibling that differs in a version or a modifier; an unknown sibling has no licence."""
    cases = [
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Some text, CC BY-NC-SA 3.0, some text", "CC-BY-NC-SA-3.0"),
        ("Licensed under CC BY-NC-SA 2.1 JP", None),
        ("licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 9.", None),
        ("GPLv2", "GPL-2.0"),
        ("code under LGPL 2.1 and more", "LGPL-2.1"),
        ("Apache Software License, Version 1.1", "Apache-1.1"),
        ("Eclipse Public License - v 1.0", "EPL-1.0"),
    ]
    assert licences_of(spark, [t for t, _ in cases]) == [n for _, n in cases]


def test_bpe_equals_the_library_on_every_code_point():
    """Each code point within a word, at its end, and after a number, whatever Unicode version knows it."""
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1" for c in codes]
    wrong = [c for c, got, want in zip(codes, coder.encode(texts), tokenizer().encode_batch_fast(texts, add_special_tokens=False)) if list(memoryview(got).cast("I")) != want.ids]
    assert not wrong, (len(wrong), [hex(ord(c)) for c in wrong[:20]])


def test_bpe_of_random_unicode_equals_the_library():
    rng = random.Random(11)
    coder = bpe.WordBpe(P.path("word_bpe_49k.json"))
    odd = ["₏", "Ᲊ", "Ɤ", "\U0002ebf0", "\U0001d7ca", "͸"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.2 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    for text, got, want in zip(texts, coder.encode(texts), tokenizer().encode_batch_fast(texts, add_special_tokens=False)):
        assert list(memoryview(got).cast("I")) == want.ids, text
