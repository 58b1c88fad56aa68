"""The pipeline against a brute-force one, and its stages on tables that lack or repeat things."""

from __future__ import annotations

import random
import zlib

import numpy as np

import corpus_pipeline
from specloom.llm import toxicity
from specloom.llm.common import fold_of
from tests.llm import util
from tests.llm.test_text_ops import _deduped, _words

BENCH = [(1, "this passage of the benchmark has exactly twelve words in it now"), (2, None), (3, "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list[tuple], list[tuple]]:
    g = random.Random(8)
    rows, labels = [], []
    banner = "This banner line stands in a lot of documents"
    for i in range(240):
        w = util.words(g, g.randint(20, 120)).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w.insert(g.randrange(len(w)), g.choice(["grubblish", "snorkfang", "vilewort"]))
        if i % 20 == 1:
            w[10:10] = BENCH[0][1].upper().split()
        text = " ".join(w)
        if i % 6 == 2:
            text = f"{banner}\n{text}"
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    for i in range(240, 300):  # copies and near copies of the first ones
        w = rows[(i - 240) * 2 + 1][1].split()
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \n "), (403, util.words(g, 6000)), (404, "two words")]
    return rows, labels


def brute(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fold_of("k", 3) != 1)
    top, total, _ = model.tag([(t or "").encode() for _, t in rows])
    rows = [r for r, s in zip(rows, model.score(top, total), strict=True) if s < toxicity.PREDICT_AT]
    clean = len(rows)
    null = {i for i, t in rows if t is None}
    rows = [(i, None if i in null else t) for i, _, _, t in _deduped(rows)]
    root = util.groups([i for i, _ in rows], util.near_links(rows, 5))
    rows = [(i, t) for i, t in rows if root[i] == i]
    single = len(rows)
    items = [_words(t) for _, t in BENCH]
    wins = {tuple(x[p : p + 10]) for x in items if x for p in range(len(x) - 9)}
    rows = [(i, t) for i, t in rows if not any(tuple(w[p : p + 10]) in wins for w in [_words(t)] for p in range(len(w) - 9))]
    assert clean < 305 and single < clean - 20 and len(rows) < single - 5
    return rows


def test_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, labels = corpus()
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in brute(spark, rows, labels):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, a, len(ids), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.start, r.doc_tokens, r.ids_crc32) for r in out} == want and len(out) == len(want)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    some, none = util.documents(spark), util.documents(spark, [])
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, d).columns == none.columns, name
        assert stage(spark, none, d).count() == 0, name
        assert {r.doc_id for r in stage(spark, some, d).collect()} >= {None, 1, 4, 5, 6, 9, 15}, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, d).count() == 0
