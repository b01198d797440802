"""Token counts that follow edits.

A document is held as slots: white space and the run of other characters after it. A segment tree over the slots sums
their code points and tokens. An edit finds its slots by the code points in logarithmic time; only they, and a slot on
the left for context, are encoded again, and the sums above them brought up to date. The tokenizer drops white space
and never joins across it, so counts equal those of encoding the edited text anew.

Nulls: a null text is empty, null edits are none, a null bound is 0, a null replacement empty. Bounds beyond the text
are cut to it; an end before its start counts as the start. Null doc_ids are carried; repeated rows are documents of
their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import sub_batches

SPACE = " \t\n\v\f\r"
_SLOT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
COUNTS = "doc_id long, n_tokens long, n_tokens_edited long, n_slots long, n_edits int, n_reencoded_chars long"


class CountTree:
    """Slots of one document with sums of code points and tokens. ``count``: the tokens of each of a list of slots."""

    def __init__(self, slots: list[str], tokens: np.ndarray, count):
        self.count, self.reencoded = count, 0
        self._build(slots, tokens)

    def _build(self, slots: list[str], tokens: np.ndarray) -> None:
        self.slots = slots
        self.size = 1 << max(1, (max(1, len(slots)) - 1).bit_length())
        self.chars = np.zeros(2 * self.size, np.int64)
        self.tokens = np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(slots)] = [len(s) for s in slots]
        self.tokens[self.size : self.size + len(slots)] = tokens
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2

    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds code point ``at``, and where it begins. Beyond the end: the last slot with text."""
        at = min(at, int(self.chars[1]) - 1)
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += int(self.chars[i])
                i += 1
        return i - self.size, begin

    def _set(self, slot: int, text: str, tokens: int) -> None:
        self.slots[slot] = text
        i = self.size + slot
        change = len(text) - int(self.chars[i]), tokens - int(self.tokens[i])
        while i:
            self.chars[i] += change[0]
            self.tokens[i] += change[1]
            i //= 2

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace code points ``start`` to ``end`` of the text as it is now.

        The touched slots are split anew. New slots take the places of the old ones and of empty ones after them; where
        these don't suffice, the tree is laid out again with as many empty ones, and nothing else is encoded.
        """
        length = int(self.chars[1])
        start = min(max(0, start), length)
        end = min(max(start, end), length)
        first, last, new = 0, len(self.slots) - 1, text
        if length:
            first, begin = self.find(max(0, start - 1))  # the slot on the left, whose last word may grow
            last, _ = self.find(end)
            old = "".join(self.slots[first : last + 1])
            new = old[: start - begin] + text + old[end - begin :]
        own = _SLOT.findall(new)
        tokens = self.count(own)
        self.reencoded += len(new)
        stop = last + 1
        while stop - first < len(own) and stop < len(self.slots) and not self.slots[stop]:
            stop += 1
        if len(own) > stop - first:
            spare = np.zeros(len(own), np.int64)
            kept = self.tokens[self.size : self.size + len(self.slots)]
            self._build(self.slots[:first] + own + [""] * len(own) + self.slots[stop:], np.concatenate((kept[:first], tokens, spare, kept[stop:])))
            return
        for i in range(stop - first):
            slot = own[i] if i < len(own) else ""
            if slot or self.slots[first + i]:
                self._set(first + i, slot, int(tokens[i]) if slot else 0)


def count_edited(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts before and after the edits of ``docs`` (doc_id, text, edits: array of (start, stop, text))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowspark.llm.tokens import shared

        encoder = shared(path)

        def count(slots: list[str]) -> np.ndarray:
            number: dict[str, int] = {}  # not pandas' factorize, which takes strings as equal up to a U+0000
            codes = [number.setdefault(s.strip(SPACE), len(number)) for s in slots]
            return encoder.lengths(list(number))[codes] if codes else np.zeros(0, np.int64)

        for batch in sub_batches(batches, "text", encoders=False):
            slots = [_SLOT.findall(t or "") for t in batch.column("text").to_pylist()]
            tokens = count([s for own in slots for s in own])
            rows, at = [], 0
            for doc, own, edits in zip(batch.column("doc_id").to_pylist(), slots, batch.column("edits").to_pylist(), strict=True):
                n = len(own)
                tree = CountTree(own, tokens[at : at + n], count)
                at += n
                before = tree.total()
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                rows.append((doc, before, tree.total(), n, len(edits or []), tree.reencoded))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_tokens", "n_tokens_edited", "n_slots", "n_edits", "n_reencoded_chars"])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, COUNTS)


def review_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits each, as a reviewer might make: an insertion, a deletion and a replacement."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, stop, text: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))
    third, half, late = F.floor(n / 3), F.floor(n / 2), F.floor(n * 2 / 3)
    return docs.select("doc_id", "text", F.array(edit(third, third, F.lit(" an added remark ")), edit(half, half + 10, F.lit("")), edit(late, late + 5, F.concat(F.lit("v"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).alias("edits"))
