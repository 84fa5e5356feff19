"""Fill-in-middle, WARC revisits and hard negatives against plain versions of themselves."""

import base64
import random
import re
from collections import defaultdict
from hashlib import sha1, sha256

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from keyfold.llm import fim, hard_negatives, warc

FIM_TEXTS = ["", None, "a", "one two  three\nfour\n\nfive", "holds <S> already", "ends with <", "<M", ">P<", "漢字 😀👍🏽 é́ \r\n\t", "\n\n", "   ", "word " * 700, "x" * 5_000, "<P", "same", "same"]


def plain_fim(doc_id, text, pattern):
    text = text or ""
    spans = [m.end() for m in re.finditer(pattern, text)]
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(spans)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = ([0] + spans)[low], ([0] + spans)[high]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("unit", ["char", "word", "line", "[aeiou]"])
def test_fim_matches_brute_force(spark, unit):
    rows = [(i, t) for i, t in enumerate(FIM_TEXTS * 6)] + [(None, "no id here"), (3, "again with id three"), (3, "again with id three")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, form string, h1 int, output int")
    out = fim.transform(docs, unit).select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    want = sorted(repr((i, *plain_fim(i, t, fim.UNITS.get(unit, unit)), t or "")) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in out) == want
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_fim_keeps_no_units_and_stops_at_the_larger_rank():
    taken = []

    def find(text, at=0):
        for m in re.finditer("(?s:.)", text[at:]):
            taken.append(m.end())
            yield m

    assert fim.cut_places(find, "a" * 100, 10, 30) == (10, 30)
    assert len(taken) == 30
    assert fim.cut_places(find, "a" * 9, 0, 0) == (0, 0)
    for n in (0, 1, fim.STRIDE - 1, fim.STRIDE, fim.STRIDE + 1, 3 * fim.STRIDE):
        assert fim.count_units(re.compile("(?s:.)").finditer, "é" * n) == n


def test_fim_of_an_empty_table_and_of_empty_units(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([], "doc_id long, text string"), "x*")


def page_rows():
    rng = random.Random(5)
    bodies = [None, "", "<p>é漢</p>", "a\r\n\r\nb", "x" * 3_000, "Content-Length: 7\r\n\r\n"] + [f"<html>{rng.random()}</html>" for _ in range(20)]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(120)] + [(i, "http://h/hot", "hot body") for i in range(1000, 1100)]
    rows += [(7, "http://h/7", "seven"), (7, "http://h/7", "seven"), (None, None, "seven"), (None, "u\r\nWARC-Type: x", "lone"), (None, "b", "lone"), (2000, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [0, 6])
def test_warc_matches_brute_force_and_restores(spark, tmp_path, least):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, digest int, payload string").repartition(5)
    manifest = warc.archive(pages, f"file://{tmp_path}/w", least, "2026-01-01T00:00:00Z", most=2_000)
    assert manifest.count() > 5  # archives are closed at their bound
    got = warc.read(manifest).collect()
    assert len(got) == len(rows) == manifest.agg(F.sum("records")).first()[0]
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    want = []
    for body, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        digest = base64.b32encode(sha1(body).digest()).decode()
        first = known[0] if known else None
        ordered = known + [None] * (len(ids) - len(known))
        for k, i in enumerate(ordered):
            again = k > 0 and len(body) >= least
            want.append(repr((i, len(body), digest, "revisit" if again else "response", first if again else None)))
    assert sorted(repr(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in got) == sorted(want)
    by_record = {r["record_id"]: r for r in got}
    assert len(by_record) == len(got)
    for r in got:
        if r["record_type"] == "revisit":
            assert by_record[r["refers_to_record"]]["record_type"] == "response"
            assert by_record[r["refers_to_record"]]["payload_digest"] == r["payload_digest"]
    back = sorted(repr((r["page_id"], r["html"])) for r in warc.restore(manifest).collect())
    assert back == sorted(repr((i, h or "")) for i, _, h in rows)
    assert {r["url"] for r in got} >= {"urn:page:", "urn:page:2000", "u%0D%0AWARC-Type: x"}
    assert [p.name for p in tmp_path.iterdir()] == ["w"]  # the archives of the first step are gone


def test_warc_restores_a_hot_payload_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "REVISITS", 10)
    pages = spark.createDataFrame([(i, "u", "same") for i in range(95)] + [(200, "u", "other")], "page_id long, url string, html string")
    manifest = warc.archive(pages, f"file://{tmp_path}/w")
    assert sorted(tuple(r) for r in warc.restore(manifest).select("page_id", "html").collect()) == [*[(i, "same") for i in range(95)], (200, "other")]


def test_warc_files_are_gzip_members_and_damage_is_noticed(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "u", "one"), (2, "v", "one")], "page_id long, url string, html string").coalesce(1)
    name = warc.archive(pages, f"file://{tmp_path}/w").first()["file"]
    fs, path = pafs.FileSystem.from_uri(name)
    raw = open(path, "rb").read()
    text = gzip.decompress(raw).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("WARC-Type: revisit") == 1 and text.count("one") == 1
    open(path, "wb").write(raw[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark.createDataFrame([(name,)], "file string")).collect()


def test_warc_of_an_empty_table(spark):
    assert warc.revisits(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def mined(rows, every, k, low, high, scale=256):
    rows = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    one = {}
    for i, label, v in rows:
        one[i] = min(one.get(i, (label, v)), (label, v))
    width = max((len(v) for _, v in one.values()), default=0)
    q = {i: [int(np.floor(scale * np.float64(x))) for x in v] + [0] * (width - len(v)) for i, (_, v) in one.items()}
    out = set()
    for a in one:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q[a], q[i])) for i in one if i != a}
        best = sorted((i for i in score if one[i][0] == one[a][0]), key=lambda i: (-score[i], i))[:k]
        for p in best:
            found = sorted((i for i in score if one[i][0] != one[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]), key=lambda i: (-score[i], i))[:k]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(found, 1)}
    return out


VECTORS = "vec_id long, label int, embedding array<float>, low long, windows string"


def vector_rows(n, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=8)
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in centre + spread * rng.normal(size=8)]) for i in range(n)]
    rows += [(n + i, int(i % 2), rows[3][2]) for i in range(60)]  # ties: one vector of two labels
    rows += [(n + 100, None, rows[0][2]), (n + 101, 1, None), (n + 102, 1, [None] * 8), (n + 103, 1, [float("nan")] * 8), (n + 104, 0, [float("inf")] * 8), (None, 1, rows[0][2])]
    rows += [rows[5], rows[5], (n + 105, 2, rows[1][2][:3]), (n + 106, 2, [])]
    return rows


@pytest.mark.parametrize("bits,low,high,spread", [(7, 80, 100, 0.3), (4, 60, 99, 1.0)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, bits, low, high, spread):
    monkeypatch.setattr(hard_negatives, "RADIX_BITS", bits)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    rows = vector_rows(400, bits, spread)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df, 20, low=low, high=high).collect()]
    assert len(got) == len(set(got))
    assert set(got) == mined(rows, 20, 5, low, high)
    assert got


def test_hard_negatives_large_components_use_wider_numbers(spark):
    rows = [(i, i % 2, [float((i % 7 - 3) * 3e4), 1e5, float(i * 1e4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in hard_negatives.mine(df, 10).collect()} == mined(rows, 10, 5, 80, 100)
    with pytest.raises(Exception, match="64 bits|too large"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30])], "vec_id long, label int, embedding array<double>")).collect()


def test_hard_negatives_without_anchors_positives_or_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(1, 0, [1.0])], [(0, 0, [1.0])], [(0, 0, [1.0]), (1, 1, [1.0])], [(0, 0, [1.0]), (1, 0, [-1.0]), (2, 1, [-0.9])]):
        assert hard_negatives.mine(spark.createDataFrame(rows, schema)).count() == 0
    labelled = hard_negatives.shifted(spark.createDataFrame([(7, 9, [1.0]), (8, 9, [1.0]), (14, None, [1.0])], schema)).collect()
    assert [r["label"] for r in labelled] == [0, 9, None]
