"""Ranked search against brute force, and the index's order."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowspark.llm import ranked_search
from flowspark.llm.ranked_search import build_index, search

from .helpers import corpus, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    own = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    many, every = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in own:
            m = 25 + 75 * n * many // every
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank, None if gone else d, -s) for rank, (s, gone, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def asked(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, q string, rank int")


@pytest.mark.parametrize("cluster,block,query_terms", [(256, 4096, 1 << 18), (4, 16, 30)])
def test_search(spark, cluster, block, query_terms):
    rng = random.Random(cluster)
    docs = corpus() + [(None, "kamon kamon rubel"), (None, None), (3, "kamon again"), (500, "Éclair éclair ECLAIR 42, a_b")]
    texts = [t for _, t in docs if t and len(t) < 3000]
    items = [(i, " ".join(rng.choice(texts).split()[: rng.randint(1, 12)])) for i in range(25)]
    items += [(100, None), (101, ""), (102, "... !?"), (103, "unheardof"), (0, "KAMON kamon kamon"), (104, "éclair 42 b A"), (None, "one two"), (105, texts[2] + " " + texts[2])]
    index = build_index(frame(spark, docs), cluster, block)
    got = search(index, asked(spark, items), query_terms=query_terms, first=2).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs, items)


def test_ties_go_to_the_least_doc_id(spark):
    docs = [(d, "alpha beta") for d in random.Random(1).sample(range(1000), 90)] + [(2000 + d, "gamma") for d in range(200)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), 4, 32)
    assert sorted(str(tuple(r)) for r in search(index, asked(spark, [(1, "beta")])).collect()) == brute(docs, [(1, "beta")])


def test_large_scores_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "EXACT", 1)
    docs = corpus()[:30]
    items = [(1, docs[4][1]), (2, docs[7][1] * 3)]
    assert sorted(str(tuple(r)) for r in search(build_index(frame(spark, docs), 4), asked(spark, items)).collect()) == brute(docs, items)


def test_no_rows(spark):
    none = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search(build_index(none), asked(spark, [(1, "a")])).count() == 0
    assert search(build_index(some), asked(spark, [(1, None)])).count() == 0
    assert search(build_index(some), asked(spark, [(1, "a")])).count() == 1


def test_bisection_brings_topics_together():
    """Documents of eight topics, shuffled: leaves hold one topic each for the most part."""
    rng = np.random.default_rng(3)
    topic = rng.permutation(np.repeat(np.arange(8), 64))
    doc = np.repeat(np.arange(512), 20)
    term = topic[doc] * 100 + rng.integers(0, 100, len(doc))
    order, cuts = ranked_search.bisect(doc, term, 512, 64)
    assert sorted(order) == list(range(512)) and list(cuts) == list(range(0, 513, 64))
    pure = np.mean([np.bincount(topic[order[a:b]]).max() / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)])
    assert pure > 0.9


def test_sql(spark, tmp_path):
    import duckdb

    docs, items = corpus() + [(3, "kamon"), (None, "kamon")], [(1, "kamon rubel"), (2, None), (3, "two ONE")]
    frame(spark, docs, False).write.parquet(str(tmp_path / "d"))
    asked(spark, items).write.parquet(str(tmp_path / "b"))
    rows = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/d/*.parquet'), benchmark AS (FROM '{tmp_path}/b/*.parquet') SELECT * FROM ({ranked_search.oracle_sql()})").fetchall()
    assert sorted(map(str, rows)) == brute(docs, items)
