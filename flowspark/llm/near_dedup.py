"""Near duplicates: MinHash bands for candidates, odd sketches to drop weak ones, full shingle sets to confirm.

1. One pass over whole texts makes, per document, a MinHash signature in bands, an odd sketch (its samples folded into a
   parity bitmap), the number of shingles and a 128-bit fingerprint of the shingle set.
2. Documents of equal sets form a class with its least doc_id; only that one goes on. Thousands of copies cost one row.
3. Members of a band's bucket are tested against its first and its last document; other bands have other ones. Buckets
   whose members are then all in one component are done. Documents of the others are joined on the rarest shingles of
   their sets: a pair of the wanted similarity shares one of the first n - ceil(0.8 n) + 1 by rarity, so none is lost,
   while near copies that differ by shingles of their own share none. What comes after the first common shingle, and
   bitmaps of the sets, bound what a pair has in common. Pairs within a component are left out: they change none.
4. A pair is tested by XOR of the odd sketches, whose population count estimates the similarity (with a margin of five
   standard deviations), and confirmed on both whole texts' shingle sets.

With 48 bands of 6 rows, a pair of similarity 0.8 shares no bucket with a probability of 5e-7.

Links rest on 64-bit hashes of shingles, classes on 128-bit sums of them.

Nulls: a null or empty text has no shingles and is linked with nothing. For ``link``, a row without a doc_id is linked
with nothing and kept, and rows of one doc_id are one document with the links of all. For ``keep_first`` each row is a
document. Other columns are ignored. Tables that the result of ``link`` reads stay in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import Words, discard, doc_windows, free_name, materialize, mix64, sub_batches
from flowspark.llm.components import components

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 48, 6
SKETCH_BITS = 1024
#: Rows of one shingle that a task pairs with others; more are dealt to several.
SHARE_ROWS = 500

_rng = np.random.default_rng(20240117)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin (length n + 1)."""
    w = Words(texts, lower=True)
    h = w.hashes()
    s, at = doc_windows(w, h, width)
    d = w.doc[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(few):
        whole = [mix64(np.array([int(sum(int(x) * pow(3, k + 1, 1 << 64) for k, x in enumerate(h[w.first[i] : w.first[i + 1]]))) + int(w.counts[i]) & ((1 << 64) - 1)], np.uint64))[0] for i in few]
        s, d = np.concatenate((s, np.array(whole, np.uint64))), np.concatenate((d, few))
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(w.counts) + 1))


def fingerprints(s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the fingerprints of the sets of ``s`` that begin at ``starts``, none of them empty."""
    halves = (mix64(s ^ np.uint64(0x5851F42D4C957F2D)), mix64(s + np.uint64(0x14057B7EF767814F)))
    return tuple(np.add.reduceat(h, starts).view(np.int64) for h in halves)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands, sketch, bitmap) of each row; the last three are null without shingles.

    ``bitmap``: a bit for each value of a hash that some shingle has.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            s, at = shingle_sets(batch.column("text"), width)
            n = np.diff(at)
            full = np.flatnonzero(n)
            starts = at[:-1][full]
            f1, f2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            bands: list = [None] * len(n)
            odd: list = [None] * len(n)
            bitmap: list = [None] * len(n)
            if len(full):
                f1[full], f2[full] = fingerprints(s, starts)
                x = (s >> np.uint64(32)).astype(np.uint32)
                least = np.empty((len(_A), len(full)), np.uint32)
                for j in range(len(_A)):
                    np.minimum.reduceat(x * _A[j] + _B[j], starts, out=least[j])
                samples = mix64((np.arange(len(_A), dtype=np.uint64)[:, None] << np.uint64(32)) | least)
                keys = np.zeros((BANDS, len(full)), np.uint64)
                for r in range(ROWS):
                    keys = mix64(keys * np.uint64(31) + samples[r::ROWS])
                bit = (samples % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(full)) * SKETCH_BITS
                parity = (np.bincount(bit.ravel(), minlength=len(full) * SKETCH_BITS) & 1).astype(np.uint8)
                own = np.zeros(len(full) * SKETCH_BITS, np.uint8)
                own[(s % np.uint64(SKETCH_BITS)).astype(np.int64) + np.repeat(np.arange(len(full)), n[full]) * SKETCH_BITS] = 1
                words = [np.packbits(b).view(np.int64).reshape(len(full), -1).tolist() for b in (parity, own)]
                for i, k, o, b in zip(full, np.ascontiguousarray(keys.T).view(np.int64).tolist(), *words, strict=True):
                    bands[i], odd[i], bitmap[i] = k, o, b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(bitmap, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch", "bitmap"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>, bitmap array<long>")


def weakest_parity(percent: int, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """The largest XOR population count of a pair that may reach ``percent``, five standard deviations included."""
    j = percent / 100
    differ = 2 * samples * (1 - j) + 5 * 2 * (samples * j * (1 - j)) ** 0.5
    odd = bits / 2 * (1 - (1 - 2 / bits) ** differ)
    return int(odd + 5 * (odd * (1 - odd / bits)) ** 0.5) + 1


def _confirm(pairs: DataFrame, marks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that are similar: by odd sketches, then by full sets."""
    words = SKETCH_BITS // 64
    side = [marks.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "uv"]
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col("su")[i].bitwiseXOR(F.col("sv")[i])) for i in range(words)])
    near = pairs.join(side[0], "u").join(side[1], "v").where((100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (apart <= weakest_parity(percent))).select("u", "v")
    both = near.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "tu"):
            sets = [shingle_sets(batch.column(c), width) for c in ("tu", "tv")]
            keep = []
            for i in range(batch.num_rows):
                a, b = (s[at[i] : at[i + 1]] for s, at in sets)
                common = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return both.mapInArrow(test, "u long, v long").distinct()


def _open(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """(doc_id, component) of the members of buckets with several components."""
    named = materialize(buckets.join(joined, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "named")
    several = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    unsettled = materialize(named.join(several, "key", "left_semi").select("doc_id", "component").distinct(), "unsettled")
    discard(named)
    return unsettled


def _main_parts(prefix: DataFrame) -> DataFrame:
    """(shingle, main, shares) of shingles with several components: the most frequent one, of equals the greatest.

    ``shares``: among how many the shingle's rows are dealt. All this is read on both sides of a join, so that it must
    not depend on the order of rows.
    """
    parts = prefix.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    own = parts.groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("c")).where("parts > 1")
    return own.select("shingle", "main", (1 + F.floor(F.col("c") / SHARE_ROWS)).cast("int").alias("shares"))


def _rare_pairs(unsettled: DataFrame, texts: DataFrame, marks: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share one of each other's rarest shingles.

    ``unsettled``: (doc_id, component). A doc_id with several texts is paired by each of them. Of each shingle's
    documents, those of its most frequent component are not paired with each other, nor gathered: the others are joined
    to all. The rows of a frequent shingle are dealt to several tasks, and the others go to each of these.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            s, at = shingle_sets(batch.column("text"), width)
            n = np.diff(at)
            rows = np.repeat(np.arange(len(n)), n)
            full = np.flatnonzero(n)
            whole = np.full(len(s), -1)  # what is of the whole text stands at its first shingle only
            whole[at[:-1][full]] = np.arange(len(full))
            whole = pa.array(whole, mask=whole < 0)
            halves = fingerprints(s, at[:-1][full]) if len(full) else (np.zeros(0, np.int64),) * 2
            own = [c.take(pa.array(full)) for c in (batch.column("doc_id"), batch.column("component"))] + [pa.array(f) for f in halves]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), pa.array(n[rows]), pa.array(s.view(np.int64)), *[c.take(whole) for c in own]], ["row", "n", "shingle", "doc_id", "component", "f1", "f2"])

    # a key for each distinct text: texts of one doc_id have ranks and prefixes of their own
    keyed = texts.join(unsettled, "doc_id").select("doc_id", "component", "text").distinct().withColumn("row", F.monotonically_increasing_id())
    all_shingles = materialize(keyed.mapInArrow(spread, "row long, n long, shingle long, doc_id long, component long, f1 long, f2 long"), "shingles")
    rows = all_shingles.select("row", "n", "shingle")
    bitmaps = marks.select("doc_id", "f1", "f2", "bitmap").dropDuplicates(["doc_id", "f1", "f2"])
    whole = all_shingles.where("doc_id is not null").select("row", "doc_id", "component", "f1", "f2").join(bitmaps, ["doc_id", "f1", "f2"]).select("row", "doc_id", "component", "bitmap")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    first = F.row_number().over(Window.partitionBy("row").orderBy("df", "shingle"))
    ranked = rows.join(common, "shingle", "left").select("row", "n", "shingle", F.coalesce("df", F.lit(1)).alias("df"))
    prefix = ranked.select("*", first.alias("rank")).where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1)).select("row", (F.col("n") - F.col("rank") + 1).alias("rest"), "n", "shingle")
    prefix = materialize(prefix.join(whole, "row").drop("row"), "prefix")
    discard(all_shingles)
    mixed = prefix.join(_main_parts(prefix), "shingle").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
    fewer = mixed.where("component != main").select("shingle", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("doc_id").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("rest").alias("ru"), F.col("bitmap").alias("bu"))
    # a bit that one has and the other lacks is a shingle, at least, that they don't share
    lacks = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(SKETCH_BITS // 64)])
    enough = lambda most: 100 * most >= percent * (F.col("nu") + F.col("n") - most)
    # from the first shingle that two have in common on, the rest of either bounds what is in common
    after = F.least("ru", "rest")
    most = F.least(F.col("nu") - lacks("bu", "bitmap"), F.col("n") - lacks("bitmap", "bu"))
    pairs = fewer.join(mixed, ["shingle", "share"]).where((F.col("cu") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("u") < F.col("doc_id"))) & enough(after)).where(enough(most))
    found = materialize(pairs.select(F.least("u", "doc_id").alias("u"), F.greatest("u", "doc_id").alias("v")).distinct(), "pairs")
    discard(prefix)
    return found


def link(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    ``component_id``: the least doc_id reachable over links of at least ``percent`` hundredths of similarity.
    """
    all_rows = materialize(sketches(docs, width), "sketches")
    linkable = all_rows.where("doc_id is not null and n_shingles > 0")
    classes = linkable.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("first"))
    member = materialize(linkable.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"]).select("doc_id", "first").distinct(), "classes")
    firsts = linkable.join(classes.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    spread = firsts.select("doc_id", F.explode("bands").alias("key")).distinct()
    shared = spread.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("tail")).where("lead < tail")
    buckets = materialize(spread.join(shared, "key"), "buckets")
    ids = buckets.select("doc_id").distinct()
    marks = linkable.select("doc_id", "f1", "f2", "sketch", "bitmap", "n_shingles").join(ids, "doc_id", "left_semi")
    texts = materialize(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "texts")
    marks = materialize(marks, "marks")

    # a doc_id of several classes holds them together
    least = member.groupBy("doc_id").agg(F.min("first").alias("u"), F.max("first").alias("last")).where("u < last").select("doc_id", "u")
    held = materialize(member.join(least, "doc_id").where("first != u").select("u", F.col("first").alias("v")).distinct(), "held")

    leaders = buckets.select("doc_id", F.explode(F.array("lead", "tail")).alias("leader")).where("doc_id != leader")
    tested = leaders.select(F.least("doc_id", "leader").alias("u"), F.greatest("doc_id", "leader").alias("v")).distinct()
    joined = components(_confirm(tested, marks, texts, width, percent).union(held))
    unsettled = _open(buckets, joined)
    pairs = _rare_pairs(unsettled, texts, marks, width, percent)
    joined = components(_confirm(pairs, marks, texts, width, percent).union(joined))
    for done in (buckets, marks, texts, held, unsettled, pairs):
        discard(done)

    found = member.join(joined, F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("component", "first").alias("found"))
    per_doc = found.groupBy("doc_id").agg(F.min("found").alias("found"))
    return all_rows.select("doc_id", "n_shingles").join(per_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("found", "doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` (with columns doc_id and text) of each group of near duplicates, all columns kept.

    Every row is a document, also where doc_ids repeat or are null; of each group the row of the least doc_id stays.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        own = free_name(docs, "kept")
        kept = link(docs, width, percent).where("kept").select(F.col("doc_id").alias(own))
        return docs.join(kept, F.col("doc_id") == F.col(own), "left_semi")
    row = free_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    rows = numbered.select(F.col(row).alias("doc_id"), "text")
    groups = link(rows, width, percent).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    kept = numbered.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(order)["row"].alias(row))
    return numbered.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
