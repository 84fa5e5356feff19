import random
import zlib

import numpy as np
import pytest

from keyfold.llm import langid, quality, toxicity

EDGE = [(9001, None), (9002, ""), (9003, "!!! 123"), (9004, "z " * 40_000), (9004, "z " * 40_000), (None, "some words")]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def corpus(spark, n=900):
    rng = random.Random(8)
    syllables = {"en": "th er on an the ing ed".split(), "fr": "é ou eau ion que re".split(), "de": "sch ung ein ach ü".split()}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(syllables))
        w = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(10, 300))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "scummy"]))
        if not good:
            w = [x + rng.choice(["###", "%%%", "!!"]) for x in w] if rng.random() < 0.5 else [x for x in w[:20] for _ in range(15)]
        docs.append((i, " ".join(w), lang, "s"))
        labels.append((i, int(good), int(toxic)))
    labels += [(5, None, None), (None, 1, 0), (5, labels[5][1], labels[5][2])]
    d = spark.createDataFrame(docs + [(i, t, None, "s") for i, t in EDGE], "doc_id long, text string, lang string, score string").repartition(4)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_classifier_on_held_out_rows(spark, what):
    d, y, docs, labels = corpus(spark)
    module, folds, fold, cut = (quality, 3, 1, 0.5) if what == "quality" else (toxicity, 4, 2, 0.3)
    got = module.classify(d, y).collect()
    assert len(got) == len(docs) + len(EDGE)
    truth = {r[0]: r[1 if what == "quality" else 2] for r in labels[: len(docs)]}
    hits = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, folds) == fold)
        if r.held_out and r.doc_id in truth:
            hits.append(r.predicted == truth[r.doc_id])
    assert np.mean(hits) > 0.93
    one = y.where(f"{what} = 1")
    assert all(r.score > 0.9 for r in module.classify(d.limit(20), one).collect())
    assert module.classify(d.limit(0), y).count() == 0
    assert module.classify(d.limit(5), y.limit(0)).count() == 5


def test_labels_of_the_held_out_fold_change_nothing(spark):
    d, y, _, _ = corpus(spark, 300)
    flipped = y.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a = {r.doc_id: r.score for r in toxicity.classify(d, y).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.classify(d, flipped).collect()}


def test_kept_rows_are_those_that_are_predicted_good(spark):
    d, y, _, _ = corpus(spark, 300)
    good = sorted((r.doc_id or -1) for r in quality.classify(d, y).collect() if r.predicted)
    out = quality.keep_good(d, y)
    assert out.columns == d.columns and sorted((r.doc_id or -1) for r in out.collect()) == good


def test_network_gradient():
    rng = np.random.default_rng(1)
    net = quality.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, valid = quality.pack([bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (900, 1024, 300)])
    owner, y, w = np.array([0, 0, 1]), np.array([1.0, 0.0]), np.array([0.5, 0.5])
    g = net.step(x, valid, owner, y, w)

    def loss():
        emb = net.p["embed"][x].reshape(len(x), 512, -1)
        act = np.maximum(np.concatenate([emb[:, k : k + 510] for k in range(3)], axis=2) @ net.p["filter"] + net.p["bias"], 0)
        z = net._head(net._pool(act, valid), owner, 2)[2]
        return float((w * (np.logaddexp(0, z) - y * z)).sum())

    for name in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        if name == "embed":
            at = (98, 1)
        was, eps = net.p[name][at], 1e-5
        net.p[name][at] = was + eps
        up = loss()
        net.p[name][at] = was - eps
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-3 * max(0.05, abs(g[name][at])), name


def test_chunks_cover_the_whole_text_and_tables_equal_the_filters():
    for n in (0, 1, 128, 1024, 1025, 5000):
        raw = bytes(range(256)) * 20
        parts = quality.chunks_of(raw[:n])
        assert b"".join(p if k == len(parts) - 1 else p[: quality.STEP] for k, p in enumerate(parts)) == raw[:n]
    net = quality.Network(2)
    x, _ = quality.pack([bytes(np.random.default_rng(3).integers(0, 256, 1024).astype(np.uint8))])
    emb = net.p["embed"][x].reshape(1, 512, -1)
    direct = np.concatenate([emb[:, k : k + 510] for k in range(3)], axis=2) @ net.p["filter"]
    pairs, t = x.view("<u2"), net.tables()
    assert np.allclose(t[0][pairs[:, :-2]] + t[1][pairs[:, 1:-1]] + t[2][pairs[:, 2:]], direct, atol=1e-4)


def test_language(spark):
    d, _, docs, _ = corpus(spark)
    got = langid.identify(d).collect()
    lang = {r[0]: r[2] for r in docs}
    hits = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id in lang]
    assert len(got) == len(docs) + len(EDGE) and np.mean(hits) > 0.98
    edge = {r.doc_id: r for r in got if r.doc_id in (9001, 9002, 9003)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in edge.values())
    assert {r.lang_pred for r in langid.identify(d.where("lang = 'en'")).collect()} == {"en"}
    assert {r.lang_pred for r in langid.identify(d.where("lang is null")).collect()} == {"und"}
    assert langid.identify(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 4, 5, 9, 40])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert set(np.unique(code)) <= {-1.0, 1.0} and far >= max(1, code.shape[1] // 5)


def test_toxicity_keeps_words_by_occurrence():
    """A word with one left neighbour and one successor in several texts is known, and so is its bigram; copies count once."""
    texts = [f"a{i} b{i} you zork now c{i}" for i in range(3)] + [f"d{i} e{i} plain words here f{i}" for i in range(3)] + ["lone copy"] * 3
    m = toxicity._estimate(texts, np.array([1, 1, 1, 0, 0, 0, 0, 0, 0]))
    assert "zork" in m.vocab and "lone" not in m.vocab
    v = len(m.vocab) + 1
    assert m.vocab["you"] * v + m.vocab["zork"] in m.keys


def test_toxicity_repeating_a_word_hides_no_other():
    texts = [f"you {w} now {w} then {i}" for i in range(4) for w in ("zork", "blarg")] + [f"plain {w} here {w} there {i}" for i in range(4) for w in ("quiet", "words")]
    m = toxicity._estimate(texts, np.array([1] * 8 + [0] * 8))
    one, many = m.evidence(["you zork now then blarg", "you zork now " * 40 + "then blarg"])
    at = 2 + len(toxicity.WINDOWS)
    assert np.allclose(one[at:], many[at:])


def test_toxicity_against_brute_force_kneser_ney():
    """The whole text's evidence is the mean log ratio of two bigram models worked out by dictionaries."""
    from collections import Counter
    from math import log

    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["bad worse bad worse a b"] * 3
    labels = [int("bad" in t or rng.random() < 0.4) for t in texts]
    model = toxicity._estimate(texts, np.array(labels))
    grams, types = [], []
    for c in (0, 1):
        own = {t for t, y in zip(texts, labels) if y == c}
        grams.append(Counter((u, w) for t in own for u, w in zip(["<s>", *t.split()], t.split())))
        types.append(Counter(w for _, w in grams[c]))
    words = {w for t in texts for w in t.split()}
    size = len(words) + 1

    def discount(counts):
        n = [max(1, sum(v == k for v in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(0.9 * k, max(0.3 * k, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
        return lambda v: d[min(v, 3) - 1] if v else 0.0

    follow = Counter(w for _, w in {*grams[0], *grams[1]})
    shared = {w: max(follow[w] - 0.75, 0) / sum(follow.values()) for w in words}
    rest = (1 - sum(shared.values())) / size

    def p(c, u, w):
        du, d2 = discount({**types[c], **{x: 0 for x in words - types[c].keys()}}), discount(grams[c])
        total = sum(types[c].values())
        low = (types[c][w] - du(types[c][w])) / total + sum(map(du, types[c].values())) / total * (shared[w] + rest)
        after = {x: v for (y, x), v in grams[c].items() if y == u}
        n = sum(after.values())
        seen = after.get(w, 0) if grams[0][u, w] + grams[1][u, w] >= 2 else 0  # a bigram that occurs once is left to the totals
        return low if not n else (seen - d2(seen)) / n + sum(map(d2, after.values())) / n * low

    for t in texts[:20] + ["bad worse a", "h g f e", "worse bad bad"]:
        w = t.split()
        steps = [log(p(1, u, x) / p(0, u, x)) for u, x in zip(w, w[1:])]
        first = model.uni[model.vocab[w[0]]]
        assert np.isclose(model.evidence([t])[0, 0], (first + sum(steps)) / len(w), atol=1e-6), t


def test_quality_score_against_loops():
    """One probability from loops over chunks, positions and filters."""
    net = quality.Network(7)
    texts = ["ab" * 40, "The quick brown fox. " * 90, "", "é"]
    p = net.p
    for text, got in zip(texts, net.score(texts, net.tables())):
        pooled = []
        for chunk in quality.chunks_of(text.encode()):
            raw = chunk.ljust(quality.CHUNK, b"\0")
            n = max(0, min(quality.CHUNK // 2 - 2, (len(chunk) + 1) // 2))
            act = np.zeros((max(n, 1), quality.FILTERS))
            for k in range(n):
                at = 2 * k
                x = np.concatenate([p["embed"][b] for b in raw[at : at + 6]])
                act[k] = np.maximum(x @ p["filter"] + p["bias"], 0)
            pooled.append(np.maximum(act.max(axis=0) @ p["hidden"] + p["hbias"], 0))
        z = np.max(pooled, axis=0) @ p["out"] + p["obias"][0]
        assert np.isclose(got, 1 / (1 + np.exp(-z)), atol=1e-4)


def test_language_decoding_against_loops():
    """The codeword of least weighted loss, by loops over codewords and bits."""
    words = {"de": "der und ich nicht schön", "en": "the and not with nice", "fr": "le et ne pas très", "es": "el y no con muy", "it": "il e non che molto"}
    rng = random.Random(6)
    make = lambda lang: " ".join(rng.choice(words[lang].split()) for _ in range(12))
    langs = [x for x in words for _ in range(20)]
    model = langid.fit([make(x) for x in langs], langs, 60)
    texts = [make(x) for x in words]
    losses = model.losses(np.stack([langid.features(t) for t in texts]))
    for k, t in enumerate(texts):
        f = [sum(float(a) * float(b) for a, b in zip(langid.features(t), model.weights[:, bit])) + model.bias[bit] for bit in range(model.code.shape[1])]
        brute = [sum(model.trust[bit] * np.log1p(np.exp(-f[bit] * row[bit])) for bit in range(len(f))) for row in model.code]
        assert np.allclose(losses[k], brute, atol=1e-4) and model.langs[int(np.argmin(brute))] == list(words)[k]


def test_toxicity_counts_by_spark_equal_counts_in_memory(spark):
    """Copies, one repeated row, unknown words and empty texts, spread over partitions."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["vile a b"] * 3
    labels = [int(rng.random() < 0.3) for _ in range(80)] + [1] * 3
    rows = [(t, y, 1) for t, y in dict.fromkeys(zip(texts, labels))]
    rows = [(t, y, 2) for t, y, _ in rows[:9] for _ in "ab"] + rows[9:]
    want = toxicity._estimate(texts, np.array(labels))
    got = toxicity.estimate(spark.createDataFrame(rows, "text string, y int, copies int").repartition(5))
    assert got.vocab == want.vocab and np.array_equal(got.keys, want.keys) and len(got.keys) > 50
    assert np.allclose(got.uni, want.uni) and np.allclose(got.back, want.back) and np.allclose(got.bi, want.bi)


def test_toxicity_keeps_the_most_frequent(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 2, 3, 9, 40])], "i long, n long")
    kept = lambda most: sorted(r.i for r in toxicity.most_frequent(df, most).collect())
    assert kept(9) == [2, 3, 4, 5, 6] and kept(4) == [4, 5, 6] and kept(1) == [6] and kept(0) == []


@pytest.mark.parametrize("most", [(1 << 18, 30), (6, 10), (0, 0)])
def test_toxicity_words_and_bigrams_beyond_the_frequent_ones_count_in_full(spark, monkeypatch, most):
    """With few words and pairs handed to the tasks, each text's score is that of the whole models."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 50))) + rng.choice(["", f" once{i}"]) for i in range(90)]
    labels = [int(rng.random() < 0.3) for _ in texts]
    rows = spark.createDataFrame(list(dict.fromkeys((t, y, 1) for t, y in zip(texts, labels))), "text string, y int, copies int").repartition(5)
    whole = toxicity._estimate(texts, np.array(labels))
    monkeypatch.setattr(toxicity, "VOCABULARY", most[0])
    monkeypatch.setattr(toxicity, "BIGRAMS", most[1])
    monkeypatch.setattr(toxicity, "GROUP", 2000)
    model = toxicity.estimate(rows)
    assert len(model.keys) <= most[1] and len(model.vocab) <= max(most[0], 0) and len(model.keys) < len(whole.keys)
    asked = [*texts, None, "", "once3 never", f"{words[0]} never {words[1]} {words[2]}", texts[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string").repartition(3)
    model.coef = whole.coef = np.array([0.1, 1.3, -0.2, 0.7, 0.4, -0.5, 0.3, 0.6])
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(asked) and np.allclose([got[i] for i in range(len(asked))], whole.scores(asked))


@pytest.mark.parametrize("few", [0, 9, 1 << 16])
def test_toxicity_sieve_tells_every_counted_word(spark, monkeypatch, few):
    """However short the last list may be, words that occur twice are told from those that occur once, one by one."""
    monkeypatch.setattr(toxicity, "FEW", few)
    codes, _ = toxicity.hashes([f"w{i}" for i in range(3000)], 0)
    n = np.where(np.arange(3000) % 3 == 0, 2, 1)
    levels, last = toxicity.sieve(spark.createDataFrame([(int(u), int(k)) for u, k in zip(codes, n)], "u long, n long"))
    assert len(last) <= few and (not levels) == (few > 3000)
    assert np.array_equal(toxicity.sifted(levels, last, codes), n == 2)


def test_toxicity_scores_texts_where_they_are_read(spark, monkeypatch):
    """Texts, and what they need of the rest, are not shuffled; the rest lies in many files, each text's score is that of the whole models."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 80)}" for _ in range(rng.randint(1, 60))) for _ in range(120)]
    labels = [int(rng.random() < 0.3) for _ in texts]
    whole = toxicity._estimate(texts, np.array(labels))
    for name, most in (("VOCABULARY", 20), ("BIGRAMS", 15), ("GROUP", 100)):
        monkeypatch.setattr(toxicity, name, most)
    model = toxicity.estimate(spark.createDataFrame(list(dict.fromkeys((t, y, 1) for t, y in zip(texts, labels))), "text string, y int, copies int"))
    assert len(model.vocab) <= 20 and len(model.rest.files) > 4
    model.coef = whole.coef = np.array([0.1, 1.3, -0.2, 0.7, 0.4, -0.5, 0.3, 0.6])
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    scores = {r.doc_id: r.score for r in got.collect()}
    assert np.allclose([scores[i] for i in range(len(texts))], whole.scores(texts))
