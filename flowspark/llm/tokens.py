"""Token ids of whole texts by a public tokenizer, many documents at a time.

The tokenizer's own rules never join characters across white space, so a text's ids are the ids of its runs of other
characters, one after the other; nor does it join letters with the marks after them, so the ids of letters and marks are
those of the two. Each distinct part of a batch is encoded once, letters by the library's merge model alone (the steps
before it map each letter by itself); frequent parts are kept between batches in a store of bounded size.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
CACHE_ENTRIES = 400_000
#: Words that the merge model gets at once.
WORDS = 500
#: Runs below this number are encoded as they are.
FEW = 64
#: Letters whose composed and lower-case forms are single letters, and marks that may follow them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?$%&*#"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _in_a_row(ids: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of items by number, one item after the other: item k has those from ``bounds[k]`` to ``bounds[k + 1]``."""
    if not len(at):
        return np.zeros(0, np.uint32)
    items = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids)])
    _, ends, got = items.take(pa.array(at)).buffers()
    return np.frombuffer(got, np.uint32, np.frombuffer(ends, np.int64)[len(at)] // 4) if got else np.zeros(0, np.uint32)


class Encoder:
    """Ids of texts as numpy arrays. ``path``: a file of the tokenizers library that drops white space.

    ``special_as_text``: encode the strings of special tokens as ordinary text; as the library does, they give their
    ids otherwise. Known parts are numbers into one array of ids; a full store keeps the more frequent half.
    """

    def __init__(self, path: str | None = None, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        letters = [chr(c) for r in (range(97, 123), range(0xDF, 0xF7), range(0xF8, 0x100)) for c in r]
        # the merge model alone, for many words at once where its ids tell where a word ends
        self.words = Tokenizer(self.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        suffix, vocabulary = getattr(self.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.letters = {ord(c): "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.stored = 1
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.length, self.hits = (np.zeros(1 << 17, t) for t in (np.int64, np.int64, np.int32))

    def _store(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = self.stored, len(parts)
        while n + m > len(self.begin):
            self.begin, self.length, self.hits = (np.resize(a, 2 * len(a)) for a in (self.begin, self.length, self.hits))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.hits[n : n + m] = 0
        self.used += len(ids)
        self.stored += m
        self.known.update(zip(parts, range(n, n + m), strict=True))

    def _keep_frequent(self) -> None:
        """Start anew with the half of the known parts that most batches had."""
        words = np.array(list(self.known), dtype=object)[1:]
        at = np.fromiter(self.known.values(), np.int64, len(words) + 1)[1:]
        order = np.argsort(-self.hits[at], kind="stable")[: len(words) // 2]
        at, hits, n = at[order], self.hits[at[order]], self.length[at[order]]
        ids = self._gather(at)
        self.clear()
        self._store(words[order].tolist(), ids, n)
        self.hits[1 : 1 + len(hits)] = hits // 2

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of parts by number, in a row."""
        return _in_a_row(self.flat, np.append(self.begin[: self.stored], self.used), at)

    def _words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts that are lower-case letters alone, in a row, and the number of ids of each."""
        mapped = [p.translate(self.letters) for p in parts]
        rows = self.words.encode_batch_fast([" ".join(mapped[i : i + WORDS]) for i in range(0, len(mapped), WORDS)], add_special_tokens=False)
        ids = np.concatenate([np.array(r.ids, np.uint32) for r in rows])
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(parts):
            return ids, np.diff(ends, prepend=-1)
        lists = [[t.id for t in self.model.tokenize(p)] for p in mapped]  # of a model that doesn't mark ends
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(e) for e in lists], np.int64)

    def _numbers(self, parts: list[str], letters: np.ndarray) -> np.ndarray:
        """The number of each distinct part in the store; ``letters``: whether a part is lower-case letters alone."""
        known = self.known
        at = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        for plain in (True, False):
            missing = np.flatnonzero((at < 0) & (letters == plain)).tolist()
            for i in range(0, len(missing), 20_000):
                some = [parts[k] for k in missing[i : i + 20_000]]
                if plain:
                    ids, lengths = self._words(some)
                else:
                    lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                    ids, lengths = np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(e) for e in lists], np.int64)
                at[missing[i : i + 20_000]] = self.stored + np.arange(len(some))
                self._store(some, ids, lengths)
        self.hits[at] += 1
        return at

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the two parts - letters or all, and marks - of each distinct run without ASCII white space."""
        if len(self.known) > CACHE_ENTRIES:
            self._keep_frequent()
        bare = pc.utf8_rtrim(runs, _MARKS)
        plain = pc.match_substring_regex(bare, f"^[{_LETTERS}]+$")
        first = pc.if_else(plain, pc.utf8_lower(bare), runs).dictionary_encode()
        is_plain = plain.to_numpy(zero_copy_only=False)
        codes = first.indices.to_numpy(zero_copy_only=False)
        letters = np.zeros(len(first.dictionary), bool)
        letters[codes] = is_plain
        one = self._numbers(_strings(first.dictionary), letters)[codes]
        two = np.zeros(len(runs), np.int64)
        with_marks = np.flatnonzero(is_plain & (pc.binary_length(bare).to_numpy(zero_copy_only=False) < pc.binary_length(runs).to_numpy(zero_copy_only=False)))
        if len(with_marks):
            at = pa.array(with_marks)
            marks = pa.array([r[n:] for r, n in zip(_strings(runs.take(at)), pc.utf8_length(bare.take(at)).to_numpy().tolist(), strict=True)]).dictionary_encode()
            two[with_marks] = self._numbers(_strings(marks.dictionary), np.zeros(len(marks.dictionary), bool))[marks.indices.to_numpy(zero_copy_only=False)]
        return one, two

    def lengths(self, runs: list[str]) -> np.ndarray:
        """The number of ids of each distinct run."""
        if len(runs) < FEW:  # not worth parting
            if len(self.known) > CACHE_ENTRIES:
                self._keep_frequent()
            at = self._numbers(runs, np.zeros(len(runs), bool))  # first, since the arrays are replaced when the store grows
            return self.length[at]
        one, two = self._runs(pa.array(runs, pa.string()))
        return self.length[one] + self.length[two]

    def batch(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text. A null text has none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        runs = split.flatten().dictionary_encode()
        if not len(runs):
            return np.zeros(0, np.uint32), counts
        codes = runs.indices.to_numpy(zero_copy_only=False)
        one, two = self._runs(runs.dictionary.cast(pa.large_string()))
        n = self.length[one] + self.length[two]
        own = self._gather(np.stack([one, two], axis=1).ravel())  # of each distinct run, in a row
        ids = _in_a_row(own, np.concatenate(([0], np.cumsum(n))), codes)
        bound = np.concatenate(([0], np.cumsum(n[codes])))
        upto = np.cumsum(counts)
        return ids, bound[upto] - bound[upto - counts]


@functools.lru_cache(1)
def shared(path: str | None) -> Encoder:
    """The encoder of this Python worker, kept between tasks that encode; tasks of other kinds drop it."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str | None, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For Arrow batches with a column ``text``: slices, their ids and the number of ids of each row."""
    from flowspark.llm.common import sub_batches

    for batch in sub_batches(batches, "text", most, encoders=False):
        yield batch, *shared(path).batch(batch.column("text"))
