from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_dedup import plain_copies, plain_near

from __spark_entry__ import SMALL, queries
from sightmatch.llm import bpe, langid, quality
from sightmatch.llm.queries import ENGLISH, trusted_ids


def test_run_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # Models are checked on their own; here their judgements are taken from the other interface.
    kept = {r.doc_id for r in quality.judge(docs, trusted_ids(spark, SMALL)).collect() if r.kept}
    good = docs.filter(docs.doc_id.isin(list(kept)))
    named = langid.predict(good, langid.fit(good)).collect()
    known = {r.doc_id for r in named if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE}
    rows = [(r.doc_id, r.text) for r in good.collect() if r.doc_id in known]
    single = {i for i, _, _, stays, _ in plain_copies(rows) if stays}
    rows = [(i, t) for i, t in rows if i in single]
    left = {i for i, _, _, stays in plain_near(rows, 5, 80) if stays}
    texts = {i: t for i, t in rows if i in left}
    got = corpus_pipeline.run(spark, SMALL).collect()
    pieces, bins = defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id] += r.length
    assert set(pieces) == left and len(left) < len(single) < docs.count()
    for i, own in pieces.items():
        ids = bpe.load(ENGLISH).encode([texts[i]])[0] + bytes(4)
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids) // 4)
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    assert max(bins.values()) <= 1024


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_and_take_odd_rows(spark, k, tmp_path):
    name, stage = corpus_pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id int, nth int"
    rows = [(i, f"some words that make a text number {i}", "en", "s", 1, 2, 3) for i in range(30)]
    rows += [(50, None, None, None, None, None, None), (None, None, None, None, None, None, None)]
    rows += [(51, "", "de", "s", 0, 0, 0), rows[0], (52, "word " * 20_000, "en", "s", 0, 0, 0)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, str(tmp_path))
    if k + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} >= ({0} if name == "near_dedup" else {0, 1, 29})
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_registered():
    known = queries()
    assert "pipeline" in known
    assert {name.split("_")[0] for name in known} >= {f"op{n}" for n in range(1, 11)}
    assert np.all([callable(f) for f in known.values()])
