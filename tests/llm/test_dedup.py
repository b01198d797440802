from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from flowspark.llm.common import Words, window_hashes
from flowspark.llm.components import components
from flowspark.llm.near_dedup import _main_parts, _rare_pairs, keep_first, link, sketches, weakest_parity
from flowspark.llm.substring_dedup import remove_repeats

from .helpers import corpus, frame, prose, words

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = words((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_links(rows, width, percent=80):
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_words_and_windows():
    texts = ["a bc\td", None, "", " x ", "ü ö"]
    w = Words(pa.array(texts))
    assert w.counts.tolist() == [3, 0, 0, 1, 2]
    h = w.hashes()
    assert len(set(h.tolist())) == 6
    x = np.arange(30, dtype=np.uint64)
    assert all(len(window_hashes(x, k)) == 31 - k for k in (1, 2, 3, 7, 20, 30)) and len(window_hashes(x, 31)) == 0
    twice = np.concatenate((x, x))
    assert (window_hashes(twice, 13)[:18] == window_hashes(twice, 13)[30:48]).all()


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup_is_exact(spark, width):
    rows = corpus()
    got = {r["doc_id"]: r for r in link(frame(spark, [*rows, (None, rows[3][1])]), width).collect()}
    want = brute_links(rows, width)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items() if d is not None} == want
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items() if d is not None)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_near_dedup_of_a_large_group(spark):
    """Near copies around a base, some within reach of a few others only: components come out whole."""
    rng = random.Random(4)
    base = prose(rng, 150).split()
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 6, 7, 8))):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        rows.append((d, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in link(frame(spark, rows), 4).collect()}
    assert got == {d: c for d, (_, c) in brute_links(rows, 4).items()}


def test_rare_pairs_lose_no_link(spark):
    rows = [r for r in corpus(3) if r[1]]
    texts = frame(spark, rows, extra=False)
    alone = spark.createDataFrame([(d, d) for d, _ in rows], "doc_id long, component long")
    found = {(r["u"], r["v"]) for r in _rare_pairs(alone, texts, sketches(texts, 4), 4, 80).collect()}
    sets = {d: shingles(t, 4) for d, t in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert (a, b) in found


def test_main_part_does_not_depend_on_the_order_of_rows(spark):
    """Ties are the usual case; whatever comes last, the same component is left out."""
    rows = [(s, c) for s in range(60) for c in (1, 2)] + [(99, 5), (99, 5), (99, 8), (100, 3)]
    want = {**dict.fromkeys(range(60), 2), 99: 5}
    for some in (rows, rows[::-1], sorted(rows, key=lambda r: r[1]), sorted(rows, key=lambda r: -r[1])):
        prefix = spark.createDataFrame(some, "shingle long, component long")
        assert {r["shingle"]: r["main"] for r in _main_parts(prefix).collect()} == want


def _near(rng, n, share):
    """Two texts of n words of their own whose 4-shingles have a similarity of ``share`` or a little more."""
    a = [f"w{rng.random()}" for _ in range(n)]
    keep = -(-2 * share * (n - 3) // (1 + share))
    return " ".join(a), " ".join([*a[: int(keep) + 3], *[f"w{rng.random()}" for _ in range(n - int(keep) - 3)]])


def test_rare_pairs_of_repeated_and_several_texts(spark):
    """A doc_id's repeated rows, or other texts of it, take no place in the prefix of a text."""
    rng = random.Random(8)
    rows, want = [], set()
    for d in range(0, 60, 2):
        a, b = _near(rng, 103, 0.8)
        rows += [(d, a), (d + 1, b)]
        rows += {0: [(d, a), (d, a), (d + 1, b)], 2: [(d, prose(rng, 300)), (d + 1, prose(rng, 300))], 4: [(d, a.upper()), (d + 1, b)]}[d % 6]
        want.add((d, d + 1))
    alone = spark.createDataFrame([(d, d) for d in range(60)], "doc_id long, component long")
    found = {(r["u"], r["v"]) for r in _rare_pairs(alone, frame(spark, rows, extra=False), sketches(frame(spark, rows), 4), 4, 80).collect()}
    assert want <= found


def test_rows_of_one_document_hold_its_classes_together(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 40) for _ in range(3))
    near = " ".join([*b.split()[:38], "other", "end"])
    rows = [(2, a), (3, b), (5, a), (5, b), (7, b), (8, near), (9, c), (9, c), (9, near)]
    got = {(r["doc_id"], r["component_id"]) for r in link(frame(spark, rows), 4).collect()}
    assert got == {(d, 2) for d in (2, 3, 5, 7, 8, 9)}


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((r["doc_id"], r["component_id"]) for r in link(frame(spark, rows), 4).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]
    assert link(frame(spark, []), 4).count() == 0
    assert link(frame(spark, [(1, None), (2, "")]), 4).where("kept").count() == 2


def test_sketch_margin():
    assert 90 < weakest_parity(80) < 512 and weakest_parity(95) < weakest_parity(80)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (None, 3)] + [(200, x) for x in range(201, 240)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 103, 105), 100), **dict.fromkeys(range(200, 240), 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removal(rows, width):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0]))
    for i in order:
        w = words(rows[i][1])
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), rows[i][0])
    for d, t in rows:
        w, seen = words(t), set()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if first[x] != d or x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(spark):
    rows = corpus(2)
    rows += [(500, rows[40][1] + " " + rows[40][1]), (None, rows[7][1]), (500, rows[9][1])]
    out = remove_repeats(frame(spark, rows), with_text=True).collect()
    key = lambda r: (r[0] is not None, r[0], r[3])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out), key=key) == sorted(brute_removal(rows, 20), key=key)
    for r in out:
        assert sum(b - a for a, b in r["removed"]) == r["n_removed"]
        assert len(r["kept_text"].split()) == len(words(r["kept_text"])) or " " in r["kept_text"] or " " in r["kept_text"]


def test_substring_dedup_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    assert [tuple(r) for r in remove_repeats(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_substring_dedup_by_portions(spark):
    """Many portions of hashes, one passage in most documents: the same result, a portion at a time."""
    rng = random.Random(11)
    passage = prose(rng, 45)
    rows = [(d, f"{prose(rng, 30)} {passage if d % 3 else ''} {prose(rng, 30)}") for d in range(120)]
    out = remove_repeats(frame(spark, rows), portion_bytes=100).collect()
    assert sorted(tuple(r) for r in out) == sorted(brute_removal(rows, 20))


def test_a_frequent_shingle_is_dealt_to_several(spark, monkeypatch):
    monkeypatch.setattr("flowspark.llm.near_dedup.SHARE_ROWS", 3)
    rows = [r for r in corpus(3) if r[1]]
    got = {r["doc_id"]: r["component_id"] for r in link(frame(spark, rows), 4).collect()}
    assert got == {d: c for d, (_, c) in brute_links(rows, 4).items()}


def test_keep_first_of_repeated_and_null_ids(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (2, a + " tail"), (None, b), (None, b), (3, b), (4, c), (4, "other words here"), (5, None), (5, None), (None, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in keep_first(frame(spark, rows).withColumnRenamed("key", "row")).collect()), key=str)
    assert got == sorted([(1, a), (3, b), (4, c), (4, "other words here"), (5, None), (5, None), (None, "")], key=str)
    assert keep_first(frame(spark, [])).count() == 0
