"""SimHash against brute force: fingerprints, links and components, in one tile and in many."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from flowspark.llm import simhash

from .helpers import corpus, frame, words


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, width=4):
    w = words(lowered(text))
    runs = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_documents(spark):
    rng = random.Random(4)
    rows = corpus()
    long = rows[20][1]
    for _ in range(20):  # near copies: one word of many changed
        w = (long * 8).split()
        w[rng.randrange(len(w))] = "andere"
        rows.append((len(rows), " ".join(w)))
    rows += [(None, long), (3, "another text of document three"), (7, None), (7, rows[30][1])]
    fps = [(d, fingerprint(t)) for d, t in rows]
    known = [(d, f) for d, f in fps if d is not None]
    links = [(a, b) for i, (a, f) in enumerate(known) for b, g in known[i + 1 :] if (f ^ g).bit_count() <= 4]
    want = components({d for d, _ in known}, links)
    got = simhash.link(frame(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == sorted(str((d, f"{f:016x}", None if d is None else want[d])) for d, f in fps)
    assert any(want[d] != d and f for d, f in known)


@pytest.mark.parametrize("radius,tile", [(4, 16), (0, 4096)])
def test_links_in_tiles(spark, radius, tile):
    """A dense group of near fingerprints and many others, in buckets that are dealt and in such that aren't."""
    rng = random.Random(radius * 100 + tile)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:20]:
        for _ in range(6):
            for _ in range(rng.randint(1, 6)):
                base ^= 1 << rng.randrange(64)
            fps.add(base)
    hot = rng.getrandbits(64)
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(60, 64)}
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(sorted(fps))]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    got = [(r["u"], r["v"]) for r in simhash.tiled_links(classes, radius, tile).collect()]
    bits = np.array(sorted(fps), np.uint64)
    i, j = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius)
    want = components(range(len(bits)), zip(i.tolist(), j.tolist(), strict=True))
    assert components(range(len(bits)), got) == want
    assert radius == 0 or len(set(want.values())) < len(bits)


def test_dense_tile_answers_with_a_forest():
    bits = np.array(sorted(range(1 << 11), key=int.bit_count), np.uint64)
    i, j = simhash.near(bits, None, 4, 0)
    assert len(i) < len(bits) and set(components(range(len(bits)), zip(i.tolist(), j.tolist(), strict=True)).values()) == {0}


def test_long_text_and_empty_table(spark):
    text = " ".join(f"w{i % 977} w{i % 31}" for i in range(90_000))
    rows = frame(spark, [(1, text), (2, None)])
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.link(rows).collect()} == {1: f"{fingerprint(text):016x}", 2: "0" * 16}
    assert simhash.link(rows.where("doc_id > 5")).count() == 0
