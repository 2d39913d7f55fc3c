"""The pipeline's stages on a small table with planted cases, and its guard."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from segmill.llm.pii import sanitise
from segmill.llm.simhash import fingerprint
from tests.llm.fixtures import documents, nothing, prose
from tests.llm.test_quality import _plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rows = []
    for k in range(120):
        text = prose(k, 120)
        if k % 4 == 1:
            text = " ".join(x + "###" for x in text.split())
        rows.append((k, text))
    clean = prose(500, 300)
    rows += [(200 + k, clean) for k in range(5)] + [(210, clean + " end")]
    rows += [(300, "short"), (301, "again and again and yes " * 30), (302, None), (303, "")]
    rows += [(310, prose(900, 100) + " write to some.body@corp.example now")]
    return [(k, t, "en", "s", 1) for k, t in rows]


def test_stages_one_by_one(spark, tmp_path):
    rows = _corpus()
    labels = [(k, 0 if k % 4 == 1 else 1, 0) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    good = stages["quality_rules"](spark, docs, str(tmp_path)).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    base = {k for k, t, *_ in rows if (s := _plain(t)) and (s[0] < 10 or 100 * s[4] > 20 * s[0])}
    clean = {k for k, *_ in rows if k % 4 != 1 and k < 120} | {200, 201, 202, 203, 204, 210, 310}
    assert kept == clean and not kept & base

    single = stages["simhash_near_dedup"](spark, good, str(tmp_path)).cache()
    assert single.columns == docs.columns
    left = {r.doc_id: r.text for r in single.collect()}
    prints = {r.doc_id: fingerprint(r.text) for r in good.collect()}
    assert not any((prints[a] ^ prints[b]).bit_count() <= 4 for a in left for b in left if a < b)
    assert set(left) >= {k for k in clean if k < 120} | {200, 310} and not {201, 202, 203, 204, 210} & set(left)

    private = stages["pii"](spark, single, str(tmp_path))
    assert private.columns == docs.columns
    texts = {r.doc_id: r.text for r in private.collect()}
    assert texts[310].endswith(" write to [EMAIL] now") and texts[310][:400] == left[310][:400]
    assert all(texts[k] == left[k] for k in left if k != 310)

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {}
    for r in sorted(packed, key=lambda r: r.start):
        found.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert found == {k: library.encode(t, add_special_tokens=False).ids + [0] for k, t in texts.items()}
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
    assert corpus_pipeline.ORACLE_SQL is None


def test_awkward_rows(spark, tmp_path):
    docs = documents(spark, [prose(1, 50)] * 3)
    docs = docs.unionByName(docs.where("doc_id = 100").selectExpr("bigint(null) doc_id", *docs.columns[1:]))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, nothing(docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert name == "packing" or out.columns == rows.columns
            assert (out.count() == 0) == (rows.count() == 0)
    single = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in single.where("doc_id >= 100 OR doc_id IS NULL").collect() if r.doc_id) == [100]
    assert single.where("doc_id IS NULL").count() == 1
    assert single.where("doc_id = 4").count() == 1
    assert sanitise(docs).count() == docs.count()
