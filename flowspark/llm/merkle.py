"""Merkle manifest of a dataset: a digest of each row, a tree for each group, one root over all, and a proof for each row.

1. Leaves are range-sorted by group, key and digest into partitions of bounded size, and written. Each run of one group in
   one partition is a segment; segments' counts, summed over a group's partitions, give each leaf its place in the tree.
2. A task builds all aligned subtrees that lie wholly in its segment, and gives out only the topmost of them: the ragged
   boundary, about two nodes a level.
3. Boundary nodes are shuffled by the coordinate of their ancestor some levels up, which holds a bounded number of nodes
   at most, and are finished there; rounds of this reach the groups' roots. Each also tells every node its siblings.
4. The groups' roots are the leaves of one more tree, made in the same way, whose root is the dataset's.
5. Each segment meets its boundary nodes' siblings again, and every leaf gets its proof.

A digest is SHA-256 as lowercase hex text, of its inputs' text one after the other. A node is the digest of up to
``fanout`` consecutive ones; the last of a level may have fewer, even one.

Nulls: a null field counts as ``-``; a null group is a group of its own, before the others; a null key comes before the
others. Rows with equal keys are in order of their digests; equal rows are leaves of their own, with proofs of their own.
Columns other than the fields are ignored. An empty table has no root and gives no rows. Tables that the result reads
stay in the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import materialize
from flowspark.operators.folds import starts

FIELDS, GROUP, KEY = ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id"
#: Leaves of a partition, about.
ROWS = 100_000
#: Nodes below an ancestor that a task finishes, at most.
NODES = 1 << 16
STEP = "struct<before: string, after: string>"


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """Digest of a row's fields, each with its length; ``instead``: other values for some of them."""
    texts = [instead.get(f, F.col(f)).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def widths(n: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Segment:
    """Consecutive leaves of a group, and all nodes whose leaves are among them. ``levels``: (first place, nodes)."""

    def __init__(self, leaves: list[bytes], start: int, n: int, fanout: int):
        self.fanout, self.start, self.width = fanout, start, widths(n, fanout)
        self.levels: list[tuple[int, list[bytes]]] = [(start, leaves)]
        for level in range(len(self.width) - 1):
            first, nodes = self.levels[-1]
            stop = first + len(nodes)
            a, b = -(-first // fanout), self.width[level + 1] if stop == self.width[level] else stop // fanout
            if a >= b:
                break
            self.levels.append((a, [digest(*nodes[max(0, j * fanout - first) : (j + 1) * fanout - first]) for j in range(a, b)]))

    def has(self, level: int, place: int) -> bool:
        return level < len(self.levels) and self.levels[level][0] <= place < self.levels[level][0] + len(self.levels[level][1])

    def topmost(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, place, digest) of nodes whose parents aren't here."""
        for level, (first, nodes) in enumerate(self.levels):
            for place, node in enumerate(nodes, first):
                if not self.has(level + 1, place // self.fanout):
                    yield level, place, node

    def climb(self, place: int) -> tuple[int, int, list[tuple[bytes, bytes]]]:
        """The topmost node above the leaf at ``place``: its level and place, and the siblings on the way."""
        level, way, f = 0, [], self.fanout
        while self.has(level + 1, place // f):
            first, nodes = self.levels[level]
            a, b = place // f * f, min(place // f * f + f, self.width[level])
            way.append((b"".join(nodes[a - first : place - first]), b"".join(nodes[place + 1 - first : b - first])))
            level, place = level + 1, place // f
        return level, place, way


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, key, leaf, others) range-sorted and written, with ``shard`` and ``at``, a leaf's place in its segment.

    Equal leaves are parted by the number of their row, so that no partition holds a group of copies whole.
    """
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // ROWS))
    order = ["g", "key", "leaf", "row"]
    ranged = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            places = np.zeros(t.num_rows, np.int64)
            for a, b in itertools.pairwise([*starts(t, ["g"]), t.num_rows]):
                if (now := t["g"][int(a)].as_py()) != last:
                    last, at = now, 0
                places[a:b] = np.arange(at, at + b - a)
                at += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(t.num_rows, shard, np.int32)), pa.array(places)], [*batch.schema.names, "shard", "at"])

    kept = ranged.drop("row")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return materialize(kept.mapInArrow(number, f"{schema}, shard int, at long"), "leaves")


def _segments(numbered: DataFrame) -> DataFrame:
    """(shard, g, start, n): where each segment begins in its group, and the group's leaves."""
    from pyspark.sql import Window

    counts = numbered.groupBy("shard", "g").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(w.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(counts.select("shard", "g", before.alias("start"), F.sum("c").over(w).alias("n")), "segments")


def _sorted_leaves(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(t["at"].to_numpy(), kind="stable")))


def _encoded(t: pa.Table, column: str) -> list[bytes]:
    return t[column].cast(pa.binary()).to_pylist()


def _boundary(numbered: DataFrame, segments: DataFrame, fanout: int) -> DataFrame:
    """The topmost nodes of all segments: (shard, g, n, level, place, digest)."""
    out = pa.schema([("shard", pa.int32()), ("g", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])

    def build(key: tuple, leaves: pa.Table, own: pa.Table) -> pa.Table:
        n = own["n"][0].as_py()
        top = list(Segment(_encoded(_sorted_leaves(leaves), "leaf"), own["start"][0].as_py(), n, fanout).topmost())
        shard, g = (k.as_py() for k in key)
        return pa.table([[shard] * len(top), [g] * len(top), [n] * len(top), [x[0] for x in top], [x[1] for x in top], [x[2].decode() for x in top]], schema=out)

    left = numbered.select("shard", "g", "at", "leaf").groupBy("shard", "g")
    return materialize(left.cogroup(segments.groupBy("shard", "g")).applyInArrow(build, "shard int, g string, n long, level int, place long, digest string"), "boundary")


def _round(nodes: DataFrame, upto: int, fanout: int) -> DataFrame:
    """Nodes below ``upto`` (or the root) to their ancestors there.

    A row for each ancestor (``way`` null) and one for each node, with its siblings on the way and ``to``, ``to_place``.
    """
    steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    out = pa.schema([("g", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("way", steps), ("to", pa.int32()), ("to_place", pa.int64())])

    def finish(key: tuple, own: pa.Table) -> pa.Table:
        g, n = own["g"][0].as_py(), own["n"][0].as_py()
        width = widths(n, fanout)
        to = min(upto, len(width) - 1)
        digests = _encoded(own, "digest")
        level, place = own["level"].to_pylist(), own["place"].to_pylist()
        at: list[dict[int, bytes]] = [{} for _ in range(to + 1)]
        for x, p, d in zip(level, place, digests, strict=True):
            at[x][p] = d
        for x in range(min(level), to):
            for j in {p // fanout for p in at[x]}:
                at[x + 1][j] = digest(*[at[x][p] for p in range(j * fanout, min((j + 1) * fanout, width[x]))])
        ((top, d),) = at[to].items()
        rows = [(g, n, to, top, d.decode(), None, None, None)]
        for x, p in zip(level, place, strict=True):
            way, q = [], p
            for y in range(x, to):
                a, b = q // fanout * fanout, min(q // fanout * fanout + fanout, width[y])
                way.append({"before": b"".join(at[y][i] for i in range(a, q)).decode(), "after": b"".join(at[y][i] for i in range(q + 1, b)).decode()})
                q //= fanout
            rows.append((g, n, x, p, None, way, to, top))
        return pa.table([list(c) for c in zip(*rows, strict=True)], schema=out)

    ancestor = F.expr(f"place div cast(power({fanout}, {upto} - level) as long)")
    return materialize(nodes.withColumn("anc", ancestor).groupBy("g", "anc").applyInArrow(finish, f"g string, n long, level int, place long, digest string, way array<{STEP}>, to int, to_place long"), "round")


class Tree:
    """Trees of all groups of ``leaves`` (g, key, leaf, others), built when this is made.

    ``roots``: (g, subroot); ``ways``: (shard, g, start, n, level, place, way) of each boundary node, up to its group's root.
    """

    def __init__(self, leaves: DataFrame, fanout: int = 2):
        self.fanout = fanout
        self.numbered = _numbered(leaves)
        self.segments = _segments(self.numbered)
        boundary = _boundary(self.numbered, self.segments, fanout)
        largest = self.segments.agg(F.max("n")).first()[0] or 1
        height = len(widths(largest, fanout)) - 1
        jump = 1
        while fanout ** (jump + 1) <= NODES:
            jump += 1
        nodes = boundary.select("g", "n", "level", "place", "digest")
        ways = boundary.select("shard", "g", "level", "place", F.col("level").alias("to"), F.col("place").alias("to_place"), F.array().cast(f"array<{STEP}>").alias("way"))
        upto = 0
        while upto < height:
            upto += jump
            # nodes at the height asked for, and roots below it, stand for themselves
            own = (F.col("level") < upto) & ~((F.col("place") == 0) & (F.expr(f"power({fanout}, level)") >= F.col("n")))
            done = _round(nodes.where(own), upto, fanout)
            nodes = nodes.where(~own).unionByName(done.where("way is null").select("g", "n", "level", "place", "digest"))
            more = done.where("way is not null").select("g", F.col("level").alias("to"), F.col("place").alias("to_place"), F.col("way").alias("next"), F.col("to").alias("new"), F.col("to_place").alias("new_place"))
            ways = ways.join(more, ["g", "to", "to_place"], "left").select("shard", "g", "level", "place", F.coalesce("new", "to").alias("to"), F.coalesce("new_place", "to_place").alias("to_place"), F.concat("way", F.coalesce("next", F.array().cast(f"array<{STEP}>"))).alias("way"))
        self.roots = materialize(nodes.select("g", F.col("digest").alias("subroot")), "roots")
        self.ways = materialize(ways.select("shard", "g", "level", "place", "way").join(self.segments, ["shard", "g"]), "ways")

    def proofs(self, ways: DataFrame, make, schema: str, *columns: str) -> DataFrame:
        """``make`` over each segment: (its table, siblings from each leaf up to its group's root, its first row of ``ways``).

        ``ways``: those of this tree, perhaps with more columns, and with more steps.
        """
        fanout = self.fanout

        def run(key: tuple, leaves: pa.Table, own: pa.Table) -> pa.Table:
            leaves = _sorted_leaves(leaves)
            start, n = own["start"][0].as_py(), own["n"][0].as_py()
            above = {(x, p): [(s["before"].encode(), s["after"].encode()) for s in way] for x, p, way in zip(own["level"].to_pylist(), own["place"].to_pylist(), own["way"].to_pylist(), strict=True)}
            segment = Segment(_encoded(leaves, "leaf"), start, n, fanout)

            def way(i: int) -> list[tuple[bytes, bytes]]:
                level, place, steps = segment.climb(start + i)
                return steps + above[level, place]

            return make(leaves, way, own)

        left = self.numbered.select("shard", "g", "at", "leaf", *columns).groupBy("shard", "g")
        return left.cogroup(ways.groupBy("shard", "g")).applyInArrow(run, schema)


def fold(d: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for before, after in way:
        d = digest(before, d, after)
    return d


def _group(c: Column) -> Column:
    """A name of each group that is never null: null sorts first, the others bytewise."""
    return F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c.cast("string")))


def tampered(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row that was tampered with after the manifest was made: n_chars is one more. Null for other rows."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(fields, n_chars=docs["n_chars"] + 1))


def verify(docs: DataFrame, found: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = GROUP, key: str = KEY, fanout: int = 2) -> DataFrame:
    """For each row of ``docs``: its leaf, its group's root, the root over all, its proof, and whether the row fits it.

    ``found``: the leaf as it is found now, where it isn't null; it is folded with the manifest's siblings.
    ``proof_sha256``: the digest of all siblings from the leaf up, left to right.
    """
    if found is None:
        found = F.lit(None).cast("string")
    tree = Tree(docs.select(_group(F.col(group)).alias("g"), F.col(key).alias("key"), leaf(fields).alias("leaf"), found.alias("found")), fanout)
    top = Tree(tree.roots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("subroot").alias("leaf")), fanout)

    def lead(leaves: pa.Table, way, own: pa.Table) -> pa.Table:
        steps = [[{"before": a.decode(), "after": b.decode()} for a, b in way(i)] for i in range(leaves.num_rows)]
        root = [fold(d, way(i)).decode() for i, d in enumerate(_encoded(leaves, "leaf"))]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table([leaves["key"].combine_chunks(), leaves["leaf"].combine_chunks(), pa.array(root, pa.string()), pa.array(steps, kind)], names=["g", "subroot", "root", "rest"])

    groups = materialize(top.proofs(top.ways, lead, f"g string, subroot string, root string, rest array<{STEP}>", "key"), "groups")
    ways = tree.ways.join(groups, "g").withColumn("way", F.concat("way", "rest")).drop("rest")

    def prove(leaves: pa.Table, way, own: pa.Table) -> pa.Table:
        subroot, root = own["subroot"][0].as_py(), own["root"][0].as_py()
        proofs, folded = [], []
        for i, (d, other) in enumerate(zip(_encoded(leaves, "leaf"), _encoded(leaves, "found"), strict=True)):
            steps = way(i)
            proofs.append(digest(*itertools.chain.from_iterable(steps)).decode())
            folded.append(fold(d if other is None else other, steps).decode())
        n = leaves.num_rows
        return pa.table([leaves["key"].combine_chunks(), leaves["leaf"].combine_chunks(), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = docs.schema[key].dataType.simpleString()
    out = tree.proofs(ways, prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", "key", "found")
    return out.withColumnRenamed("doc_id", key)


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents``: levels by recursion; CRC-32 bit by bit over the decimal digits."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    row = lambda n: " || ".join(part(c) for c in ("doc_id", "source", "lang", n, "text"))
    bits = "list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT)"
    tree = lambda name, source, by: f"""{name} AS (SELECT 0 AS level, {by} AS g, place, node, n FROM {source}
  UNION ALL SELECT level + 1, g, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY level, g, place // 2, n)"""  # noqa: E731
    return f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS id, doc_id, lang, sha256({row('n_chars')}) AS leaf,
  CASE WHEN xor({bits}, 4294967295) % 7 = 0 THEN sha256({row('(n_chars + 1)')}) END AS found FROM documents),
lv AS (SELECT id, doc_id, leaf, found, coalesce('1' || lang, '0') AS g, leaf AS node, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM base),
{tree('tree', 'lv', 'g')},
subs AS (SELECT g AS name, '' AS one, node, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
{tree('tops', 'subs', 'one')},
path AS (SELECT lv.id, t.level AS step, t.place, s.node FROM lv JOIN tree t ON t.g = lv.g AND t.place = (lv.place >> t.level) AND t.n > 1
    LEFT JOIN tree s ON s.g = t.g AND s.level = t.level AND s.place = xor(t.place, 1)
  UNION ALL SELECT lv.id, 1000 + t.level, t.place, s.node FROM lv JOIN subs b ON b.name = lv.g JOIN tops t ON t.place = (b.place >> t.level) AND t.n > 1
    LEFT JOIN tops s ON s.level = t.level AND s.place = xor(t.place, 1)),
ways AS (SELECT id, string_agg(coalesce(node, ''), '' ORDER BY step) AS siblings,
  list(CASE WHEN place % 2 = 1 THEN coalesce(node, '') || '|' ELSE '|' || coalesce(node, '') END ORDER BY step) AS steps FROM path GROUP BY id)
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM (SELECT lv.*, siblings, list_reduce(list_prepend(coalesce(found, leaf), coalesce(steps, [])), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root FROM lv LEFT JOIN ways USING (id))
JOIN subs s ON s.name = g, (SELECT node FROM tops WHERE n = 1) r
"""
