import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from keyfold.llm import exact_dedup, near_dup

SCHEMA = "doc_id long, text string, lang string, __size int, bands int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def test_exact_labels_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Same Text", "same text", "ÉTÉ", "été", "", None, "x" * 50_000, f"own {i}"])) for i in range(400)]
    rows += [(7, "Same Text"), (7, "Same Text"), (None, "same TEXT"), (None, "lonely"), (None, "lonely")]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    got = exact_dedup.label(table(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[text]))
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_dedup_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, "b"), (None, "c"), (None, "c"), (None, "a"), (4, None), (5, "")]
    out = exact_dedup.dedup(table(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "__size", "bands"]
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(-1, "c"), (2, "A"), (3, "b"), (5, "")]


def test_exact_on_empty_table(spark):
    assert exact_dedup.label(table(spark, [])).count() == 0
    assert exact_dedup.dedup(table(spark, [])).count() == 0


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def bag(t):
    w = words(t)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """Smallest id of each connected component over all pairs."""
    bags = {i: bag(t) for i, t in rows}
    texts = dict(rows)
    parent = {i: i for i in bags}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (bags[i] and similarity(bags[i], bags[j]) >= 0.8) or (not bags[i] and not bags[j] and (texts[i] or "") == (texts[j] or "")):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def near_rows(seed=2):
    rng = random.Random(seed)
    lexicon = [f"w{k}" for k in range(400)]
    rows, passage = [], [rng.choice(lexicon) for _ in range(60)]
    for g in range(25):
        base = [rng.choice(lexicon) for _ in range(rng.choice([6, 40, 200]))] * rng.choice([1, 1, 3])
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(lexicon)
            rows.append(t)
        rows.append(passage + [rng.choice(lexicon) for _ in range(30)])
    rows = [(k, " ".join(t)) for k, t in enumerate(rows)]
    return rows + [(900, None), (901, ""), (902, "!!"), (903, "!!"), (904, "Two words"), (905, "two, WORDS"), (906, "two")]


def test_near_classes_match_all_pairs(spark):
    rows = near_rows()
    expected = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(table(spark, rows)).collect()}
    assert got == expected
    kept = {r.doc_id for r in near_dup.dedup(table(spark, rows)).collect()}
    assert kept == set(expected.values())


def test_large_group_takes_several_rounds(spark):
    """A chain of near copies in which the ends are far apart, with many exact copies."""
    base = [f"t{k}" for k in range(300)]
    rows, t = [], list(base)
    for k in range(60):
        rows.append((k, " ".join(t)))
        t[(k * 5) % 300] = f"new{k}"
    rows += [(1000 + k, rows[3][1].upper()) for k in range(200)]
    got = {r.doc_id: (r.class_id, r.n_copies) for r in near_dup.near_classes(table(spark, rows)).collect()}
    assert {c for c, _ in got.values()} == {0}
    assert got[1005][1] == 201


def test_open_members_are_searched_exactly(spark):
    """Texts around a long common passage, near in pairs or not at all, and copies with random edits whose original is missing."""
    rng = random.Random(11)
    passage, base, rows = [f"p{k}" for k in range(160)], [f"q{k}" for k in range(120)], []
    for k in range(120):
        rows.append((k, " ".join([f"own{k}x{j}" for j in range(rng.randint(2, 60))] + passage)))
    for k in range(120, 200):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = f"edit{rng.random()}"
        rows.append((k, " ".join(t)))
    expected = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(table(spark, rows)).collect()}
    assert got == expected and 20 < len(set(expected.values())) < 180


def test_links_are_spread_along_once(spark, monkeypatch):
    """Rounds of the search hand only what is new to the search for components, never a link again."""
    rng, handed, whole = random.Random(11), [], near_dup.components
    base, rows = [f"q{k}" for k in range(120)], []
    for k in range(120):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = f"edit{rng.random()}"
        rows.append((k, " ".join(t)))

    def components(links):
        links = near_dup.cut(links)
        handed.append({frozenset(r) for r in links.select("pivot", "fp").collect()})
        return whole(links)

    monkeypatch.setattr(near_dup, "components", components)
    expected = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(table(spark, rows)).collect()} == expected
    assert len(handed) > 2 and sum(map(len, handed)) == len(set().union(*handed)) < len(rows) * 4


def test_recall_against_all_pairs(spark):
    """All pairs at the threshold: at least 0.9 of them are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    classes = {r.doc_id: r.class_id for r in near_dup.near_classes(docs).collect()}
    bags, holders = {i: bag(t) for i, t in rows.items()}, {}
    for i, b in bags.items():
        for s in b:
            holders.setdefault(s, set()).add(i)
    found = [classes[i] == classes[j] for i in bags for j in set().union(*[holders[s] for s in bags[i]]) if j < i and similarity(bags[i], bags[j]) >= 0.8]
    assert len(found) > 50 and sum(found) >= 0.9 * len(found)


def test_near_dedup_of_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    keep = lambda rows: sorted((r.doc_id or -1, r.text or "", r.lang) for r in near_dup.dedup(table(spark, rows)).collect())
    assert keep([(1, a), (1, a), (2, a), (None, a)]) == [(1, a, "en")]
    assert keep([(None, b), (None, b), (None, b + " more"), (None, a)]) in ([(-1, a, "en"), (-1, b, "en")], [(-1, a, "en"), (-1, b + " more", "en")])
    assert [x[0] for x in keep([(5, a), (5, b), (9, b), (None, b + " tail"), (7, "alone"), (None, "")])] == [-1, 5, 7]
    assert keep([(3, None), (3, ""), (None, None)]) in ([(3, "", "en")],)


def test_near_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = near_dup.near_classes(table(spark, [(1, a), (2, b), (2, a), (None, a), (3, b), (4, "other words stand here alone")])).collect()
    assert sorted((r.doc_id or -1, r.class_id) for r in got if r.doc_id) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    assert near_dup.near_classes(table(spark, [])).count() == 0


def test_signature_is_an_unbiased_estimate():
    rng = np.random.default_rng(4)
    errors = []
    for trial in range(40):
        n = 120
        h = near_dup.mix64(np.arange(1 + trial * 1000, 1 + n + trial * 1000, dtype=np.uint64))
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = near_dup.signatures(doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 256)
        errors.append((s[0] == s[1]).mean() - j)
    assert abs(np.mean(errors)) < 3 * np.sqrt(0.25 / 256 / 40)


def test_shingles_follow_words():
    texts = ["One two three four five six", "one TWO three, four five six!", "été à la mer bleue", "a b", "a b c", ""]
    doc, h, count = near_dup.multisets(texts)
    sets = [dict(zip(h[doc == d].tolist(), count[doc == d].tolist())) for d in range(6)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and len(sets[2]) == 1 and sets[3] != sets[4] and not sets[5]
    assert [len(near_dup.multisets([t])[1]) for t in texts] == [2, 2, 1, 1, 1, 0]


@pytest.mark.parametrize("n", [1, 5, 400])
def test_multiset_of_one_text_and_in_a_block_agree(n):
    t = " ".join(f"x{k % 7}" for k in range(n))
    alone, block = near_dup.multisets([t]), near_dup.multisets(["before it", t, None])
    pick = block[0] == 1
    assert (alone[1] == block[1][pick]).all() and (alone[2] == block[2][pick]).all()


#: Names that the stages use inside, and their like.
INNER = "gone wanted key drop twin repeated print_of fp class_fp text_digest row id n a b part __pick __size __row __key __gone __same __again __want __fp __text item_id h w shingle ids Gone FP_".split()


@pytest.mark.parametrize("stage", ["exact", "near", "leaks"])
def test_stages_keep_extra_columns_of_any_name(spark, stage):
    from keyfold.llm import decontam

    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, long), (2, long), (2, long), (3, long + " end"), (None, long), (None, "nameless one"), (None, "nameless one"), (4, None), (5, "some other text of its own words")]
    schema = ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in dict.fromkeys(n.lower() for n in INNER)]])
    names = schema.replace("`", "").split(", ")[2:]
    docs = spark.createDataFrame([(i, t, *[f"{n} of {k}" for n in names]) for k, (i, t) in enumerate(rows)], schema)
    if stage == "exact":
        out = exact_dedup.dedup(docs)
    elif stage == "near":
        out = near_dup.dedup(docs)
    else:
        out = decontam.decontaminate(docs, spark.createDataFrame([(1, "nameless one"), (2, "text of its own words")], "item_id long, text string"))
    assert out.columns == docs.columns
    got = out.collect()
    for r in got:  # whole rows as they came
        assert len({v.rsplit(" ", 1)[1] for v in r[2:]}) == 1
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter({
        "exact": [(2, long), (3, long + " end"), (None, "nameless one"), (4, None), (5, rows[-1][1])],
        "near": [(1, long), (None, "nameless one"), (4, None), (5, rows[-1][1])],
        "leaks": [r for r in rows if r[1] != "nameless one" and r[0] != 5],
    }[stage])
