"""Folds along sorted keys in bounded memory, for what depends on the row before in ways that no window states."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: key, its next rows, the state so far (None at first): rows out, the state from now on
Fold = Callable[[tuple, pa.Table, object], tuple[pa.Table, object]]


def starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Places where a run of rows with equal ``columns`` begins; nulls are equal."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for c in columns:
        a, b = rows[c].slice(1), rows[c].slice(0, max(0, rows.num_rows - 1))
        new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new)


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fold: Fold, schema, together: str | None = None, finish: Callable[[tuple, object], pa.Table] | None = None) -> DataFrame:
    """``fold`` along each key in order. A task holds an Arrow batch and the state of one key, whatever a key's size.

    Rows of a key with equal ``together`` reach ``fold`` in one call. ``finish`` gets each key and its last state. A lost
    task folds its keys again from the shuffle.
    """

    def run(batches):
        key, state, held = None, None, None
        for batch in itertools.chain(batches, [None]):
            parts = [t for t in (held, None if batch is None else pa.Table.from_batches([batch])) if t is not None and t.num_rows]
            if not parts:
                if batch is None and finish is not None and key is not None:
                    yield from finish(key, state).combine_chunks().to_batches()
                continue
            rows = pa.concat_tables(parts).combine_chunks()
            cut = rows.num_rows if batch is None or together is None else int(starts(rows, [*keys, together])[-1])
            held, rows = rows.slice(cut), rows.slice(0, cut)
            out = []
            for a, b in itertools.pairwise([*starts(rows, keys), cut] if cut else []):
                part = rows.slice(a, b - a)
                now = tuple(part[k][0].as_py() for k in keys)
                if now != key:
                    if finish is not None and key is not None:
                        out.append(finish(key, state))
                    key, state = now, None
                got, state = fold(now, part, state)
                out.append(got)
            if batch is None and finish is not None:
                out.append(finish(key, state))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
