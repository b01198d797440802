from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowspark.llm import token_codec
from flowspark.llm.edit_counts import _SLOT as SLOT
from flowspark.llm.edit_counts import SPACE, CountTree, count_edited
from flowspark.llm.packing import OpenBins, pack, sequences, token_pieces
from flowspark.llm.token_store import read_store, round_trip, write_store
from flowspark.llm.tokens import Encoder, tokenizer_path

from .helpers import corpus, frame


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PARTS = ["a", "B", "é", "É", "ß", "İ", "ñ", "\u0301", "µ", "ª", "×", "'s", "'t", "'", "...", ",", "!?", "$", "#", "1", "\u0663", "\u4e2d", " ", " ", "\xa0", "\u2003", "\x1c", "\x85", "\n", "\t", "\x0b", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\ufb01", "Σ", "ς", "\U0001f600", "</w>", "Ÿ"]


def test_encoder_equals_the_tokenizer(plain):
    rng = random.Random(3)
    texts = [t for _, t in corpus()] + ["don't I'LL 12,5 <|endoftext|>", "é ́x İstanbul ﬁ ŉ ΣΑΣ", "汉字 かな \U0001f600", "\x1c\x85  a"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids, counts = Encoder().batch(texts)
    assert counts.tolist() == [len(plain(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in plain(t)]


def test_special_tokens_as_text(plain):
    ids, _ = Encoder(special_as_text=True).batch(["a <|endoftext|> b"])
    assert 49_407 in plain("a <|endoftext|> b") and 49_407 not in ids


def test_a_full_store_keeps_ids_right(plain, monkeypatch):
    monkeypatch.setattr("flowspark.llm.tokens.CACHE_ENTRIES", 50)
    encoder = Encoder()
    for k in range(6):
        texts = [f"wort{chr(97 + i % 26)}{'x' * (i % 7)}, le{'a' * (k % 3)}!" for i in range(60)]
        ids, _ = encoder.batch(texts)
        assert ids.tolist() == [i for t in texts for i in plain(t)]


def test_a_store_grows_while_few_runs_are_encoded(plain):
    encoder = Encoder()
    room = len(encoder.length) - encoder.stored
    encoder.lengths([f"{i}x" for i in range(room - 10)])
    few = [f"{i}y" for i in range(30)]
    assert encoder.lengths(few).tolist() == [len(plain(r)) for r in few]
    assert len(encoder.length) > room + 1


def test_few_runs_keep_the_store_bounded(plain, monkeypatch):
    monkeypatch.setattr("flowspark.llm.tokens.CACHE_ENTRIES", 50)
    encoder = Encoder()
    for k in range(40):
        few = ["the", *(f"{k}z{i}" for i in range(9))]
        assert encoder.lengths(few).tolist() == [len(plain(r)) for r in few]
        assert len(encoder.known) <= 50 + len(few)


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9000])
@pytest.mark.parametrize("high", [1, 3, 400, 49_408, 1 << 32])
def test_codec_round_trip(n, high):
    ids = np.random.default_rng(n + high).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    assert (token_codec.decode(token_codec.encode(ids)) == ids).all()


def test_codec_predicts():
    """Ids that depend on the two before take far less than their order-0 entropy."""
    rng = np.random.default_rng(5)
    after = rng.integers(0, 300, (300, 4))
    ids = np.zeros(60_000, np.uint32)
    for i in range(1, len(ids)):
        ids[i] = after[ids[i - 1], rng.integers(0, 4)]
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    frame_ = token_codec.encode(ids)
    assert (token_codec.decode(frame_) == ids).all() and 8 * len(frame_) / len(ids) < 0.8 * entropy


def test_codec_learns_and_notices_damage():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    frame_ = token_codec.encode(ids)
    assert len(frame_) < len(ids) // 4
    for at in (6, len(frame_) // 2, len(frame_) - 3):
        broken = bytearray(frame_)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            token_codec.decode(bytes(broken))


def test_store(spark, plain, tmp_path):
    rows = corpus()[::-1]
    got = sorted(tuple(r) for r in round_trip(frame(spark, rows)).collect())
    want, start = [], 0
    for d, t in sorted(rows):
        a = np.array(plain(t) + [2], "<u4")
        want.append((d, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    assert got == want
    odd = frame(spark, [(5, "b a"), (5, "b a"), (None, "c"), (4, None)])
    write_store(odd, str(tmp_path / "store"))
    out = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"]) for r in read_store(spark, str(tmp_path / "store")).collect()), key=str)
    assert [r[1:] for r in sorted(out, key=lambda r: r[2])] == [(None, 0, 2), (4, 2, 1), (5, 3, 3), (5, 6, 3)]
    assert round_trip(frame(spark, [])).count() == 0


def test_frames_of_a_shard_are_even(spark, plain, tmp_path, monkeypatch):
    """No frame holds much more than its share, and none is a small rest, which would take as many steps."""
    monkeypatch.setattr("flowspark.llm.token_store.FRAME_IDS", 1000, raising=False)
    rows = [(i, f"some words of document {i} " * 8) for i in range(70)] + [(70, "long " * 3000)]
    write_store(frame(spark, rows).coalesce(1), str(tmp_path / "even"))
    own = spark.read.parquet(str(tmp_path / "even")).select("shard", "n_ids", "lengths").collect()
    for shard in {r["shard"] for r in own}:
        sizes = [r["n_ids"] for r in own if r["shard"] == shard and max(r["lengths"]) < 1000]
        assert max(sizes, default=0) < 1100 and (len(sizes) < 2 or 3 * min(sizes) > max(sizes))
    assert len(own) > 3
    got = {r["doc_id"]: r for r in read_store(spark, str(tmp_path / "even")).collect()}
    start = 0
    for d, t in rows:
        a = np.array(plain(t) + [2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(a), zlib.crc32(a.tobytes()))
        start += len(a)


def test_contexts_of_known_ids_are_found_for_many_steps_at_once(monkeypatch):
    calls, contexts = [], getattr(token_codec._Model, "contexts", None)
    monkeypatch.setattr(token_codec._Model, "contexts", lambda self, *a: calls.append(1) or contexts(self, *a), raising=False)
    ids = np.random.default_rng(7).integers(0, 50, 5 * 2048 + 77).astype(np.uint32)
    frame_ = token_codec.encode(ids)
    assert 0 < len(calls) <= token_codec.BLOCK // 8
    assert (token_codec.decode(frame_) == ids).all()


def test_words_of_the_merge_model(plain):
    """Words that the merge model gets together have the ids that each has alone; so have those of a model without ends."""
    encoder = Encoder()
    words = [w for w in "a straße être naïve ÿ ñandú thiswordisnotinanyvocabulary ß xyzzy".split()] * 150
    for last in (encoder.last, np.zeros_like(encoder.last)):
        encoder.last = last
        ids, n = encoder._words(words)
        assert n.tolist() == [len(plain(w)) for w in words] and ids.tolist() == [i for w in words for i in plain(w)]


def test_pieces_and_packing(spark, plain):
    rows = [*corpus(), (None, "null id"), (7, "again"), (7, "again")]
    pieces = token_pieces(frame(spark, rows), with_ids=True)
    placed = pack(pieces.drop("ids")).collect()
    want = []
    for d, t in rows:
        a = np.array(plain(t) + [1], "<u4")
        want += [(d, k, s, len(a[s : s + 4096]), zlib.crc32(a[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(a), 4096))]
    assert sorted((tuple(r)[:5] for r in placed), key=str) == sorted(want, key=str)
    bins = {}
    for r in placed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(x[3] for x in want) // 4096) + 1
    assert pack(token_pieces(frame(spark, []))).count() == 0


def test_sequences(spark, plain):
    rows = [(i, f"word{i} " * (i * 40)) for i in range(30)] + [(3, "again"), (3, "again"), (None, "no id"), (None, "no id")]
    docs = frame(spark, rows)
    pieces = token_pieces(docs, capacity=256, with_ids=True)
    out = {r["sequence_id"]: r["ids"] for r in sequences(pack(pieces, capacity=256)).collect()}
    assert sum(map(len, out.values())) == sum(len(plain(t)) + 1 for _, t in rows)
    assert max(map(len, out.values())) <= 256


def test_tree_is_best_fit():
    rng = np.random.default_rng(2)
    sizes = sorted(rng.integers(1, 101, 600).tolist(), reverse=True)
    tree, rooms, order = OpenBins(100), [], []
    for s in sizes:
        number, offset = tree.place(s)
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            assert rooms[number] == min(fit)[0]
        else:
            assert number == len(rooms)
            rooms.append(100)
        assert offset == 100 - rooms[number]
        rooms[number] -= s
        order.append(number)


def test_edit_counts(spark, plain):
    edits = {0: [(0, 3, "new start")], 1: [(5, 5, "x"), (5, 6, ""), (0, 10**6, "all new text")], 2: [(10**6, 10**7, " end")], 3: [(2, 1, "swap")], 4: None, 5: [None, (None, None, None)]}
    rows = [(d, t, edits.get(d, [(4, 9, " mid "), (1, 30, "")])) for d, t in corpus()] + [(None, "a b", [(1, 2, "")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,stop:long,text:string>>")
    got = {r["doc_id"]: r for r in count_edited(df).collect()}
    for d, t, es in rows:
        y = t or ""
        for e in es or []:
            if e is not None:
                s = min(max(0, e[0] or 0), len(y))
                y = y[:s] + (e[2] or "") + y[min(max(s, e[1] or 0), len(y)) :]
        assert (got[d]["n_tokens"], got[d]["n_tokens_edited"]) == (len(plain(t)), len(plain(y))), d
    long_doc = max(corpus(), key=lambda r: len(r[1] or ""))[0]
    assert got[long_doc]["n_reencoded_chars"] < 300
    assert count_edited(df.limit(0)).count() == 0


def test_edits_of_words_with_nul(spark, plain):
    text = "one a\0b a\0longerword a two"
    df = spark.createDataFrame([(1, text, [(3, 3, " x\0y x\0anotherlongerword")])], "doc_id long, text string, edits array<struct<start:long,stop:long,text:string>>")
    row = count_edited(df).first()
    assert (row["n_tokens"], row["n_tokens_edited"]) == (len(plain(text)), len(plain(text[:3] + " x\0y x\0anotherlongerword" + text[3:])))


def test_edits_at_one_place(plain):
    """Edits inside a long insertion encode their own slots again, not the insertion."""
    encoder, rng = Encoder(), random.Random(4)
    text = "one two three four"
    slots = SLOT.findall(text)
    count = lambda own: encoder.lengths([s.strip(SPACE) for s in own]) if own else np.zeros(0, np.int64)
    tree = CountTree(slots, count(slots), count)
    edits = [(8, 8, " neu" * 25_000)] + [(rng.randrange(100_000),) * 2 + (rng.choice(("x", " y ", "")),) for _ in range(40)] + [(50_000, 50_006, ""), (3, 100_000, " gone "), (0, 10**6, ""), (0, 0, "new a b c")]
    for k, (a, b, new) in enumerate(edits):
        a, b = min(a, len(text)), min(b, len(text))
        text = text[:a] + new + text[b:]
        before = tree.reencoded
        tree.edit(a, b, new)
        assert tree.reencoded - before <= len(new) + 40
        assert "".join(tree.slots) == text and (k % 8 and k < 40 or tree.total() == len(plain(text)))


def test_edits_of_any_kind(plain):
    encoder, rng = Encoder(), random.Random(8)
    count = lambda own: encoder.lengths([s.strip(SPACE) for s in own]) if own else np.zeros(0, np.int64)
    for _ in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        slots = SLOT.findall(text)
        tree = CountTree(slots, count(slots), count)
        for _ in range(12):
            a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
            new = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert "".join(tree.slots) == text and tree.total() == len(plain(text))
