"""The pipeline against a plain version of its stages."""

import collections
import math
import random
import zlib

import numpy as np

import corpus_pipeline
from crewspark.llm import quality_lm, secret_scan
from tests.llm.conftest import DOCS, words
from tests.llm.test_corpus_operators import check_packing, plain_components, plain_kneser_ney
from tests.llm.test_text_operators import plain_leaks


def plain_quality(rows, trusted):
    """Rows (id, text, lang, ...) that stay."""
    held = lambda i: zlib.crc32(str(i).encode()) % quality_lm.HELD_OUT == 0
    out = []
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang]
        p = plain_kneser_ney([r[1] or "" for r in own if r[0] in trusted and not held(r[0])])
        nll = {}
        for r in own:
            text = quality_lm.PAD + (r[1] or "")
            nll[r] = -sum(np.log(p(text[k : k + 4])) for k in range(len(r[1] or "")))
        size = {r: len(r[1] or "") for r in own}
        test = [r for r in own if r[0] in trusted and held(r[0]) and size[r]]
        if not test:
            out += [r for r in own if size[r]]
            continue
        mean = sum(nll[r] for r in test) / sum(size[r] for r in test)
        drawn = {r: math.exp((nll[r] + quality_lm.PRIOR_CHARS * mean) / (size[r] + quality_lm.PRIOR_CHARS)) for r in own}
        ranked = sorted(drawn[r] for r in test)
        limit = ranked[math.ceil(0.995 * len(ranked)) - 1]
        out += [r for r in own if size[r] and drawn[r] <= limit * (1 + 1e-9)]
    return out


def plain_pipeline(rows, trusted, items):
    kept = plain_quality(rows, trusted)
    least = {x[0] for x in plain_components(kept, 5, 80) if x[3]}
    kept = [r for r in kept if str(r[0]) in least]
    kept = [r for r in kept if not plain_leaks(r[1], items)[4]]
    enc = secret_scan.encoder()
    return [(r[0], secret_scan.redact(r[1], secret_scan.spans_of(r[1], enc)), *r[2:]) for r in kept]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(40, 90)) + (f" token=abcd{1000 + i}efgh5678 x" if i % 4 == 0 else ""), "en", "ab"[i % 2]) for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "a") for i in range(12)]
    item = words(rng, 20)
    rows += [(300, f"{words(rng, 40)} {item} {words(rng, 20)}", "en", "a"), (301, f"{words(rng, 50)} token=abcd1234efgh5678 x", "en", "b")]
    rows += [(400 + i, " ".join("".join(rng.choice("!#%&XYZQ") for _ in range(6)) for _ in range(40)), "en", "a") for i in range(4)]
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, words(rng, 30), "fr", "b")]
    trusted = set(range(0, 120, 2))
    items = [(1, item), (2, None)]
    spark.createDataFrame([(*r, len(r[1] or ""), 1.5, "x", "y") for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in trusted), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_pipeline(rows, trusted, items)
    assert {300, 500, 501, 400, 201} & {r[0] for r in want} == set() and 502 in {r[0] for r in want} and len(want) > 80
    assert any("[SECRET]" in r[1] for r in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in want}
    check_packing(got, want)
    assert collections.Counter(r.source for r in got if r.start == 0) == collections.Counter(r[3] for r in want)


def test_stages_return_the_columns_of_documents(spark, tmp_path, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_dedup_tells_texts_under_one_id_apart(spark, make_docs):
    rng = random.Random(21)
    a, b, c = words(rng, 80), words(rng, 80), words(rng, 80)
    rows = [(1, a), (1, b), (1, b), (2, b + " x"), (3, c), (4, c), (None, words(rng, 50)), (None, None), (5, ""), (5, None), (6, a + " y"), (6, words(rng, 60)), (7, a), (7, a + " z")]
    for parts in (1, 5):
        got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, make_docs(rows).repartition(parts), "").collect()), key=str)
        want = [(1, a), (1, b), (3, c), rows[6], (None, None), (6, rows[11][1])]
        assert [x for x in got if x[0] != 5] == sorted(want, key=str)
        assert len([x for x in got if x[0] == 5]) == 1  # null and empty are one text
    near = [(9, a), (9, a + " z")]  # one document of a group, whichever rows its id has
    assert len(corpus_pipeline.near_dedup(spark, make_docs(near), "").collect()) == 1
