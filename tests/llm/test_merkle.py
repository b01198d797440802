"""The Merkle manifest against brute force: trees of many shapes, proofs, tampering."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from flowspark.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """The root, and of each node its siblings' runs up to it: (before, after)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, w in enumerate(ways):
            p = at[i]
            a = p // fanout * fanout
            w.append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + fanout])))
            at[i] = p // fanout
        nodes = [h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
    return nodes[0], ways


def manifest(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own], fanout) for x, own in parts.items()}
    root, tops = tree([trees[x][0] for x in langs], fanout)
    out = []
    for x, top in zip(langs, tops, strict=True):
        for r, way in zip(parts[x], trees[x][1], strict=True):
            way = way + top
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            d = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for before, after in way:
                d = h(before, d, after)
            out.append((r[0], leaf(r), trees[x][0], root, h(*[b + a for b, a in way]), d, d == root))
    return out


def table(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int, root string"
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], schema)


def check(spark, rows, fanout=2):
    docs = table(spark, rows)
    got = merkle.verify(docs, merkle.tampered(docs), fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, manifest(rows, fanout)))


@pytest.mark.parametrize("n,fanout,parted,below", [(157, 2, 10, 8), (83, 3, 7, 9), (1, 2, 10, 8)])
def test_manifest(spark, monkeypatch, n, fanout, parted, below):
    """Small partitions and rounds, so that trees are ragged at all levels; nulls, repeats, one hot group."""
    monkeypatch.setattr(merkle, "ROWS", parted)
    monkeypatch.setattr(merkle, "NODES", below)
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", rng.choice(("en", "en", "en", "de", "é", None)), rng.choice((None, i)), rng.choice((None, "", f"text {i} ü"))) for i in range(n)]
    if n > 1:
        rows += [rows[5]] * 9 + [(None, None, None, None, None)] * 3 + [(7, "other", "en", 1, "same id"), (None, "s", "xx", 3, "alone")]
    check(spark, rows, fanout)


def test_very_long_text_and_no_rows(spark):
    check(spark, [(7 * i, "s", "en", 3, "ä " * 400_000 if i == 3 else "b") for i in range(20)])
    assert merkle.verify(table(spark, [])).count() == 0


def test_untampered_rows_fit(spark):
    rows = merkle.verify(table(spark, [(i, "s", "ab"[i % 2], i, "t") for i in range(40)])).collect()
    assert len(rows) == 40 and all(r["verified"] and r["folded_root"] == r["root"] for r in rows)
    assert len({r["root"] for r in rows}) == 1 and len({r["subroot"] for r in rows}) == 2


def test_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(2)
    rows = [(i, "s", rng.choice(("en", "de", None)), rng.choice((None, i)), f"t{i}") for i in range(60)] + [(None, None, None, None, None), (5, "s", "fr", 1, "x")]
    table(spark, rows).select("doc_id", "source", "lang", "n_chars", "text").write.parquet(str(tmp_path / "d"))
    duckdb_rows = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/d/*.parquet') SELECT * FROM ({merkle.oracle_sql()})").fetchall()
    assert sorted(map(str, duckdb_rows)) == sorted(map(str, manifest(rows)))
