"""The pipeline's stages, each against brute force on what the stage before left."""

import random
from hashlib import sha256

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_classes
from tests.llm.test_text_ops import library

pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    lexicon = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    say = lambda n: [rng.choice(lexicon) for _ in range(n)]
    item = say(12)
    texts = []
    for k in range(60):
        base = say(rng.randint(20, 60))
        texts += [base, base] if k % 3 == 0 else [base]
        if k % 5 == 0:
            texts.append([*base[:-1], "changed"])
        if k % 7 == 0:
            texts.append([*base, *item, *say(5)])
    rows = [(i, " ".join(t), "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    rows += [(500 + k, "zz zz zz " * rng.randint(5, 30), "en", "junk", 1) for k in range(40)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (3, rows[3][1], "en", "again", 1), (None, rows[5][1].upper(), "en", "s", 1), (None, " ".join(item), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[3] != "junk")) for r in rows if r[0] is not None and r[0] < 800], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in state.collect()]
        stage(spark, state, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        state = spark.read.parquet(f"{tmp_path}/out{k}")
        after = [tuple(r) for r in state.collect()]
        if k < 4:
            assert state.columns == docs.columns and not set(after) - set(before)
        if k == 0:
            assert not [r for r in after if r[3] == "junk"] and len([r for r in after if r[1]]) >= 0.95 * len([r for r in before if r[1] and r[3] != "junk"])
        elif k == 1:
            best = {}
            for r in before:
                t = (r[1] or "").lower()
                best[t] = max(best.get(t, -1), -1 if r[0] is None else r[0])
            assert sorted((r[1] or "").lower() for r in after) == sorted(best) and all(best[(r[1] or "").lower()] in (r[0], -1) for r in after)
        elif k == 2:
            named = brute_classes([(i, r[1]) for i, r in enumerate(before)])
            assert len(after) == len(set(named.values()))
        elif k == 3:
            held = lambda t: " ".join(item) in (t or "").lower()
            assert sorted(r[1] or "" for r in after) == sorted(r[1] or "" for r in before if not held(r[1]))
            assert any(held(r[1]) for r in before)
        else:
            want = {(r[0], len(library(r[1])[0]), sha256(np.array(library(r[1])[0], "<u4").tobytes()).hexdigest()) for r in before}
            assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in state.collect()} == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)
