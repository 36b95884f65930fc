"""Prefix trie of conversations, by union-find over the LCP edges of sorted neighbours.

A conversation is the sequence of its turns' digests (16 bytes a turn). Sorted by
it, conversations with a common prefix of turns are neighbours, and the length of
the longest common prefix (LCP) of two neighbours is the depth at which their
paths part. Taking the edges between neighbours in descending order of LCP and
uniting their components builds the trie from below: a merge at depth d makes a
branching node of depth d over both (or extends the one that is there). The depths
between a branching node and its parent are nodes with the same members.

Every figure of a node is a sum over its range of the sorted order: a
conversation adds the nodes that it is the first to enter (those below the LCP
with its left neighbour) and a leaf if its right neighbour does not go on from its
end. So the order may be cut anywhere. It is cut into range partitions, ties between copies
by conv_id, so that a conversation that a third of all repeat is spread as well.
Each partition builds its own forest. Its nodes that reach no further than the
partition are done; those that a neighbour partition shares, prefixes of the
first or the last conversation, are contracted to one row of partial sums each
(its spine) and merged with the neighbours' by the digest of the prefix. Nodes
below a spine find their parent's figures by partition and depth.

The digest of a node's conversation ids is sequential by its definition. The ids of
a node that spans partitions reach its task as one string a partition, in order, and are
hashed as a stream; the task holds one such string at a time.

Defined cases: turns are ordered by turn, null first, equal ones by the digest of
role and text; null role or text is empty; repeated rows are turns of their own;
rows without conv_id belong to no conversation; a conversation without turns ends
at the root; an empty table has no nodes. One conversation's digests and text
lengths are one row (24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm import common

PART_ROWS = 10_000
PART_BYTES = 16 << 20
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; the role's length keeps role and text apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv, digests, lengths): a conversation's turn digests in hex and its texts' UTF-8 bytes, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    ordered = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes"))).alias("turns"))
    return ordered.select("conv", F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("lengths"))


def rebuilt(seqs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversation c as the first h turns of conversation c - c % ``group`` and its own turns after
    its first h; h is the CRC of c's decimal form modulo ``most``."""
    own = seqs.withColumns({"h": (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int"),
                            "base": F.col("conv") - F.col("conv") % group})
    bases = seqs.select(F.col("conv").alias("base"), F.slice("digests", 1, most - 1).alias("base_digests"),
                        F.slice("lengths", 1, most - 1).alias("base_lengths"))
    joined = own.join(bases, "base", "left")

    def spliced(name: str) -> Column:
        head = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.slice(name, 1, 0))
        rest = F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))
        return F.concat(head, rest).alias(name)

    return joined.select("conv", spliced("digests"), spliced("lengths"))


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two digest sequences begin with in common."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m // DIGEST
    x, y = np.frombuffer(a[:m], "<u8").reshape(-1, 2), np.frombuffer(b[:m], "<u8").reshape(-1, 2)
    return int((x != y).any(axis=1).argmax())


def prefix_ids(seq: bytes, depth: int) -> list[str]:
    """Names of the nodes on a path down to ``depth``: digests of the prefixes."""
    state, names = hashlib.md5(), []
    for d in range(depth + 1):
        if d:
            state.update(seq[(d - 1) * DIGEST: d * DIGEST])
        names.append(f"{d}-{state.hexdigest()}")
    return names


class Forest:
    """Branching and end nodes of a run of sorted conversations, built by union-find.

    ``edges[i]`` is the LCP of conversations i - 1 and i. A component is a range of
    conversations; its node is the deepest one over all of them.
    """

    def __init__(self, depths: np.ndarray, convs: np.ndarray, edges: np.ndarray):
        n = len(depths)
        self.depth, self.first, self.last = depths.tolist(), list(range(n)), list(range(n))
        self.least, self.parent = convs.tolist(), [-1] * n
        self.same = list(range(n))  # nodes that turned out to be one
        root, node = list(range(n)), list(range(n))

        def find(links: list[int], i: int) -> int:
            while links[i] != i:
                links[i] = links[links[i]]
                i = links[i]
            return i

        for i in sorted(range(1, n), key=edges.tolist().__getitem__, reverse=True):
            d, a, b = int(edges[i]), find(root, i - 1), find(root, i)
            x, y = find(self.same, node[a]), find(self.same, node[b])
            if self.depth[x] == d and self.depth[y] == d:
                self.same[y] = top = x
            elif self.depth[x] == d:
                self.parent[y] = top = x
            elif self.depth[y] == d:
                self.parent[x] = top = y
            else:
                top = len(self.depth)
                self.depth.append(d)
                self.first.append(self.first[x])
                self.last.append(self.last[y])
                self.least.append(self.least[x])
                self.parent.append(-1)
                self.same.append(top)
                self.parent[x] = self.parent[y] = top
            self.first[top], self.last[top] = min(self.first[x], self.first[y]), max(self.last[x], self.last[y])
            self.least[top] = min(self.least[x], self.least[y])
            root[b], node[a] = a, top
        self.nodes = [v for v in range(len(self.same)) if self.same[v] == v]
        for v in self.nodes:
            if self.parent[v] >= 0:
                self.parent[v] = find(self.same, self.parent[v])


NODE_FIELDS = [("conv_id", pa.int64(), "long"), ("depth", pa.int64(), "long"), ("parent_conv_id", pa.int64(), "long"),
               ("n_convs", pa.int64(), "long"), ("n_children", pa.int64(), "long"), ("n_leaves", pa.int64(), "long"),
               ("saved_tokens", pa.int64(), "long"), ("ends", pa.string(), "string"), ("part", pa.int32(), "int"),
               ("side", pa.string(), "string"), ("parent_side", pa.string(), "string"), ("node", pa.string(), "string"),
               ("parent", pa.string(), "string")]
NODE_SCHEMA = ", ".join(f"{name} {ddl}" for name, _, ddl in NODE_FIELDS)


def forest_rows(part: int, convs: np.ndarray, seqs: list[bytes], lengths: list[np.ndarray], left: int, right: int) -> dict[str, list]:
    """Columns of NODE_FIELDS: the nodes of one partition. ``left`` and ``right`` are the LCPs with the
    neighbour partitions (-1: none). A spine node has a ``node`` name, partial sums and its own ids as
    ``ends``; any other is whole, with the digest of its ids, and lacks ``parent_conv_id`` where
    ``parent_side`` names a parent on the spine."""
    n = len(convs)
    depths = np.array([len(s) // DIGEST for s in seqs], np.int64)
    edges = np.array([left] + [lcp(a, b) for a, b in zip(seqs, seqs[1:])] + [right], np.int64)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in lengths]  # bytes of the first d turns
    total = np.array([s[-1] for s in sums], np.int64)
    entered = total - np.array([s[max(e, 0)] for s, e in zip(sums, edges)], np.int64)
    total, fresh = (np.concatenate([[0], np.cumsum(x)]) for x in (total, entered))
    leaves = np.concatenate([[0], np.cumsum(edges[1:] < depths)])
    forest = Forest(depths, convs, edges[:n])
    children: dict[int, int] = {}
    for v in forest.nodes:
        children[forest.parent[v]] = children.get(forest.parent[v], 0) + 1
    names = {"L": prefix_ids(seqs[0], left) if left >= 0 else [], "R": prefix_ids(seqs[-1], right) if right >= 0 else []}
    out: dict[str, list] = {name: [] for name, _, _ in NODE_FIELDS}

    def reach(v: int) -> int:
        """The deepest level at which a node over v's range is shared with a neighbour partition."""
        return max(left if forest.first[v] == 0 else -1, right if forest.last[v] == n - 1 else -1)

    def side(v: int) -> str:
        return "L" if forest.first[v] == 0 else "R"

    def name(v: int, d: int) -> str:
        return names["L"][d] if forest.first[v] == 0 and d <= left else names["R"][d]

    for v in forest.nodes:
        lo, hi, bottom, up = forest.first[v], forest.last[v], forest.depth[v], forest.parent[v]
        top = forest.depth[up] + 1 if up >= 0 else 0
        shared, size = reach(v), hi - lo + 1
        ended = int(np.searchsorted(depths[lo: hi + 1] > bottom, True)) if depths[lo] == bottom else 0
        ids = ",".join(map(str, convs[lo: lo + ended].tolist()))
        for d in range(top, bottom + 1):
            above, goes_on = int(sums[lo][d - 1]) if d else 0, lo == 0 and d <= left
            distinct = int(fresh[hi + 1] - fresh[lo]) if goes_on else int(fresh[hi + 1] - fresh[lo + 1] + sums[lo][-1]) - above
            below = children.get(v, 0) if d == bottom else 1
            if goes_on and left > d:
                below -= 1  # an earlier partition has counted the child that the first conversation is in
            spine, parent_of = d <= shared, v if d > top else up
            parent_open = d > 0 and d - 1 <= reach(parent_of)
            own = (ids if ended else None) if d == bottom else None
            for key, value in (("conv_id", forest.least[v]), ("depth", d), ("n_convs", size), ("n_children", below),
                               ("n_leaves", int(leaves[hi + 1] - leaves[lo])),
                               ("saved_tokens", int(total[hi + 1] - total[lo]) - size * above - distinct),
                               ("parent_conv_id", forest.least[parent_of] if d and not parent_open else None),
                               ("ends", own if spine else NOTHING if own is None else hashlib.sha256(own.encode()).hexdigest()),
                               ("part", part), ("side", side(v) if spine else None),
                               ("parent_side", side(parent_of) if parent_open and not spine else None),
                               ("node", name(v, d) if spine else None),
                               ("parent", name(parent_of, d - 1) if spine and d else None)):
                out[key].append(value)
    return out


def _sorted_parts(seqs: DataFrame, part_rows: int, part_bytes: int) -> DataFrame:
    """(conv, seq, lengths, part, place): the conversations in sorted order, cut into parts."""
    spark = seqs.sparkSession
    rows = common.materialise(seqs.select("conv", F.unhex(F.array_join("digests", "")).alias("seq"), "lengths"), "trie-sequences")
    n, size = rows.agg(F.count("*"), F.sum(F.length("seq"))).first()
    parts = max(1, -(-n // part_rows), -(-(size or 0) // part_bytes))
    ordered = rows.repartitionByRange(parts, "seq", "conv").sortWithinPartitions("seq", "conv")
    common.bound_batches(spark)
    return common.materialise(ordered.select("*", F.spark_partition_id().alias("part"),
                                             F.monotonically_increasing_id().alias("place")), "trie-sorted")


def _boundaries(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """part → LCPs with the parts before and after it; two numbers a part reach the driver."""
    spark = ordered.sparkSession
    ends = common.materialise(ordered.groupBy("part").agg(F.min_by("seq", "place").alias("first"), F.max_by("seq", "place").alias("last")),
                              "trie-ends")
    parts = sorted(r[0] for r in ends.select("part").collect())
    if len(parts) < 2:
        return {p: (-1, -1) for p in parts}
    follows = spark.createDataFrame(list(zip(parts, parts[1:])), "before int, after int")
    pairs = (follows.join(ends.select(F.col("part").alias("before"), F.col("last").alias("a")), "before")
             .join(ends.select(F.col("part").alias("after"), F.col("first").alias("b")), "after"))

    def common_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lcp(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("before"), batch.column("after"), pa.array(found, pa.int64())],
                                             names=["before", "after", "depth"])

    out = {p: [-1, -1] for p in parts}
    for r in pairs.select("before", "after", "a", "b").mapInArrow(common_depth, "before int, after int, depth long").collect():
        out[r["before"]][1] = out[r["after"]][0] = r["depth"]
    return {p: (a, b) for p, (a, b) in out.items()}


def _digests(spine: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the spine nodes at which conversations end, each hashed as a stream of strings."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield rows(done)
        if node is not None:
            yield rows([(node, state.hexdigest())])

    def rows(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["node", "ends_sha256"])

    parts = spine.where(F.col("ends").isNotNull()).select("node", "part", "ends")
    return parts.repartition("node").sortWithinPartitions("node", "part").mapInArrow(stream, "node string, ends_sha256 string")


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(seqs: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per node of the trie over ``seqs`` (conv, digests, lengths; one row per conversation)."""
    spark: SparkSession = seqs.sparkSession
    ordered = _sorted_parts(seqs, part_rows, part_bytes)
    shared = spark.sparkContext.broadcast(_boundaries(ordered))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        part = table.column("part")[0].as_py()
        columns = forest_rows(part, table.column("conv").to_numpy(), table.column("seq").to_pylist(),
                              [np.array(x, np.int64) for x in table.column("lengths").to_pylist()], *shared.value[part])
        return pa.table([pa.array(columns[name], kind) for name, kind, _ in NODE_FIELDS], names=[f[0] for f in NODE_FIELDS])

    nodes = common.materialise(ordered.groupBy("part").applyInArrow(build, NODE_SCHEMA), "trie-nodes")
    spine = nodes.where(F.col("node").isNotNull())
    merged = spine.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = common.materialise(merged.join(_digests(spine), "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "trie-spine")
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.where(F.col("node").isNull()).withColumnRenamed("ends", "ends_sha256")
    # by part and depth: no key has more rows than a part
    places = spine.select("part", "side", "depth", F.col("node").alias("parent")).join(above, "parent").select(
        "part", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    below = whole.where(F.col("parent_side").isNotNull()).drop("parent_conv_id").join(places, ["part", "parent_side", "depth"])
    return (whole.where(F.col("parent_side").isNull()).select(*OUT).unionByName(below.select(*OUT))
            .unionByName(merged.join(above, "parent", "left").select(*OUT)))


def conversation_trie(turns: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return trie(rebuilt(sequences(turns)), part_rows, part_bytes)


ORACLE_SQL = """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(role), ':', role, text))) AS p,
         md5(concat(strlen(role), ':', role, text)) AS dig, strlen(text) AS b
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, CAST(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]),
                      lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT convs.c, p, dig, b FROM convs JOIN own ON own.c = convs.c - convs.c % 5 AND p <= h
  UNION ALL
  SELECT own.c, p, dig, b FROM own JOIN convs USING (c) WHERE p > h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, dig, b FROM turns),
paths AS (
  SELECT c, d, b, md5(string_agg(dig, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM placed
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
nodes AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM paths GROUP BY ALL),
depths AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
ends AS (
  SELECT d, node, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM paths p JOIN depths ON depths.c = p.c AND d = len GROUP BY ALL),
up AS (
  SELECT n.d, n.node, q.node AS parent FROM nodes n JOIN paths q ON q.c = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM up GROUP BY ALL),
below AS (
  SELECT q.d, q.node, sum((n.n_convs - 1) * n.b) AS saved, count(*) FILTER (WHERE k.node IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k USING (d, node) JOIN paths q ON q.c = n.conv_id AND q.d <= n.d GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, pn.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN up USING (d, node) LEFT JOIN nodes pn ON pn.d = n.d - 1 AND pn.node = up.parent
LEFT JOIN kids k ON k.d = n.d AND k.node = n.node JOIN below ON below.d = n.d AND below.node = n.node
LEFT JOIN ends ON ends.d = n.d AND ends.node = n.node
"""
