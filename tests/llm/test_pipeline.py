from __future__ import annotations

import random

import corpus_pipeline
from flowspark.llm import byte_cnn
from flowspark.llm.decontaminate import leaks

from .helpers import prose
from .test_dedup import brute_links
from .test_text import base_spans, labelled


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows, labels = labelled(240)
    items = [(i, prose(rng, 40)) for i in range(5)]
    good = [d for d, q, _ in labels if q]
    texts = dict(rows)
    texts[good[0]] += " " + items[1][1]
    texts[good[1]] = "write to me@example.org " + texts[good[1]]
    rows = [(d, t, "en", "s", len(t)) for d, t in texts.items()] + [(1000, texts[good[2]], "en", "s", 5), (1001, texts[good[3]] + " tail", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = byte_cnn.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = {r["doc_id"] for r in byte_cnn.score(docs, net).where("score >= 0.7").collect()}
    left = [(d, t) for d, t, *_ in rows if d in kept]
    left = [(d, t) for d, t in left if brute_links(left, 5)[d][1] == d]
    dirty = {r["doc_id"] for r in leaks(spark.createDataFrame(left, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert good[0] in dirty and 1000 not in dict(left) and 1001 not in dict(left)
    want = {d for d, _ in left} - dirty
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == want

    stage = dict(corpus_pipeline.STAGES)["pii"](spark, docs, str(tmp_path))
    masked = {r["doc_id"]: r for r in stage.collect()}
    assert stage.columns == docs.columns and len(masked) == len(rows)
    assert masked[good[1]]["text"].startswith("write to [email] ") and masked[good[1]]["n_chars"] == len(masked[good[1]]["text"])
    assert all(masked[d]["text"] == t for d, t, *_ in rows if d != good[1] and not base_spans(t))


def test_stages_on_edge_cases(spark, tmp_path):
    """Null and repeated doc_ids, null, empty and very long texts, extra columns with clashing names, empty tables."""
    rng = random.Random(9)
    rows, labels = labelled(90)
    items = [(0, prose(rng, 40)), (1, None), (None, prose(rng, 30))]
    long = prose(rng, 40_000)
    odd = [(None, rows[1][1]), (rows[1][0], rows[1][1]), (None, None), (501, None), (502, ""), (503, " \n\t"), (504, long), (505, long), (506, prose(rng, 80) + " " + items[0][1]), (507, "a@b.org " + prose(rng, 80)), (507, "a@b.org " + prose(rng, 90))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, k string, spans int, _row string, score double"
    docs = spark.createDataFrame([(d, t, "en", None, None, 1, "a", None, 2, "b", 0.5) for d, t in rows + odd], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (501, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "minhash_near_dedup":
            texts = [t for _, t in got if t and t.strip()]
            assert len(texts) == len(set(texts)) and (504, long) in got and (505, long) not in got
            assert sum(not (t or "").strip() for _, t in got) == 4
        if name == "benchmark_decontamination":
            assert 506 not in {d for d, _ in got} and len(got) == docs.count() - 1
        if name == "pii":
            assert len(got) == docs.count() and sum(d == 507 and t.startswith("[email] ") for d, t in got) == 2
    packed = stages["best_fit_packing"](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == docs.count()
    assert stages["best_fit_packing"](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is null").count() <= 2
