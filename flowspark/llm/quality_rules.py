"""Quality rules: statistics of whole texts, and decision lists learned from labelled ones.

``statistics`` counts words, symbols, repeated lines and repeated windows. ``learn`` covers the rejected documents of a
bounded labelled sample one rule at a time: a rule grows by the threshold with the best information gain on two thirds
of the sample, and is pruned from its end on the other third; rules that don't hold there end the list.
``DecisionList.column`` is the list as an ordered Spark conditional expression.

Nulls: a null text has no words. Null doc_ids are carried; labels join on doc_id, and rows with a null label don't
teach. Repeated rows are judged alike. Other columns are ignored. Without labels the list is empty and keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import Words, doc_windows, hashed_sample, span_hashes, sub_batches

REPEAT_WIDTH = 8
SAMPLE_ROWS = 20_000
#: Of a list, and of a rule: so many stay readable.
MOST_RULES, MOST_CONDITIONS = 12, 4
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks", "n_distinct_words")
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in SYMBOLS]] |= 1
_KIND[65:91] |= 2
_KIND[48:58] |= 4
_KIND[[ord(c) for c in "!?;:()[]{}\"=_~^/\\+@`"]] |= 8
_KIND[128:192] |= 16  # the rest of a code point


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS (long) of each row of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            w = Words(batch.column("text"))
            n = batch.num_rows
            kinds = _KIND[w.data]
            edges = np.append(w.begins, len(w.data))

            def per_doc(flags: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
                return np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])

            step = np.zeros(len(w.data) + 1, np.int8)
            step[w.start] += 1
            step[w.end] -= 1
            in_word = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            breaks = np.flatnonzero(w.data == 10)
            line_start = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
            in_upto = np.concatenate(([0], np.cumsum(in_word)))
            some = in_upto[breaks] > in_upto[line_start] if len(breaks) else np.zeros(0, bool)
            line_doc = np.searchsorted(w.ends, line_start[some])
            hashes = w.hashes()
            windows, at = doc_windows(w, hashes, REPEAT_WIDTH)
            twice = ~_once(windows, w.doc[at])
            cover = np.bincount(at[twice], minlength=len(w.start) + REPEAT_WIDTH + 1).astype(np.int64)
            cover[REPEAT_WIDTH:] -= np.bincount(at[twice], minlength=len(w.start) + REPEAT_WIDTH + 1)[:-REPEAT_WIDTH]
            repeated = np.concatenate(([0], np.cumsum(np.cumsum(cover)[: len(w.start)] > 0)))[w.first]
            out = {
                "n_words": w.counts,
                "word_chars": per_doc(in_word & (kinds & 16 == 0)),
                "n_symbols": per_doc(kinds & 1),
                "n_dup_lines": np.bincount(line_doc[_later(span_hashes(w.data, line_start[some], breaks[some]), line_doc)], minlength=n),
                "n_repeat_words": np.diff(repeated),
                "n_lines": np.bincount(line_doc, minlength=n),
                "n_capitals": per_doc((kinds & 2) >> 1),
                "n_digits": per_doc((kinds & 4) >> 2),
                "n_marks": per_doc((kinds & 8) >> 3),
                "n_distinct_words": w.counts - np.bincount(w.doc[_later(hashes, w.doc)], minlength=n),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the same hash comes earlier in the same document."""
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    return out


def _once(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.ones(len(h), bool)
    out[order[1:][same]] = False
    out[order[:-1][same]] = False
    return out


def features() -> dict[str, Column]:
    """Ratios of the counts, on which rules put thresholds."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_a_word": F.col("n_symbols") / words,
        "marks_a_word": F.col("n_marks") / words,
        "capitals_a_char": F.col("n_capitals") / chars,
        "digits_a_char": F.col("n_digits") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "words_a_line": F.col("n_words") / lines,
        "distinct_share": F.col("n_distinct_words") / words,
    }


@dataclass
class DecisionList:
    """Rules in order: a document that all conditions (feature, '>=' or '<', threshold) of one hold for is rejected."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def column(self) -> Column:
        """Whether the list keeps a row of ``statistics``; the first rule that holds decides."""
        have = features()
        decided = None
        for rule in self.rules:
            holds = F.lit(True)
            for name, op, at in rule:
                holds = holds & (have[name] >= at if op == ">=" else have[name] < at)
            decided = F.when(holds, False) if decided is None else decided.when(holds, False)
        return F.lit(True) if decided is None else decided.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{n} {op} {at:.6g}" for n, op, at in rule) for rule in self.rules)


def _holds(rule: list[tuple[str, str, float]], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, at in rule:
        out &= x[name] >= at if op == ">=" else x[name] < at
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The condition of the best information gain among the rows inside a rule."""
    p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
    best, found = 0.0, None
    for name, values in x.items():
        v, y = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(y)[cuts - 1]
        for op, p, t in (("<", below, cuts), (">=", p0 - below, len(v) - cuts)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - np.log2(p0 / (p0 + n0))), 0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), (name, op, float((v[cuts[k] - 1] + v[cuts[k]]) / 2))
    return best, found


def learn_list(sample: pd.DataFrame, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS, precision: float = 0.8) -> DecisionList:
    """Sequential covering of the rows with quality 0. ``sample``: quality and the features, in a fixed order."""
    names = list(features())
    n = len(sample)
    prune = np.arange(n) % 3 == 2
    bad = sample["quality"].to_numpy() == 0
    x = {c: sample[c].to_numpy(float) for c in names}
    left, out = np.ones(n, bool), DecisionList()
    while len(out.rules) < most_rules and (bad & left & ~prune).sum() >= 3:
        inside, rule = left & ~prune, []
        while len(rule) < most_conditions and (~bad & inside).any():
            _, condition = _best(x, bad, inside)
            if condition is None:
                break
            rule.append(condition)
            inside &= _holds([condition], x, n)

        def worth(r: list) -> tuple[float, int]:
            held = _holds(r, x, n) & left & prune
            p, q = int((held & bad).sum()), int((held & ~bad).sum())
            return ((p - q) / (p + q) if p + q else -1.0, -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])
        held = _holds(rule, x, n) & left
        if not rule or not held.any() or (held & bad).sum() < precision * held.sum() or worth(rule)[0] < 2 * precision - 1:
            break
        out.rules.append(rule)
        left &= ~held
    return out


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> DecisionList:
    """A list from a sample of at most ``sample_rows`` labelled rows, the first by a hash of doc_id.

    Every fourth row by crc32 (remainder 2) is left out, for held-out figures. Of the rows of one doc_id, that of the
    least counts teaches.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 4 != 2")
    chosen = stats.sparkSession.createDataFrame(hashed_sample(known, sample_rows, "doc_id", "quality").collect(), "doc_id long, quality int")
    own = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "quality", "s.*")
    rows = own.select("quality", F.xxhash64("doc_id").alias("at"), *(c.alias(n) for n, c in features().items()))
    return learn_list(rows.toPandas().sort_values(["at", *features(), "quality"], ignore_index=True), most_rules, most_conditions)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.column())
