"""Hierarchical weighted hash tree: region → rack → shard.

At every level a document draws one number per child, -ln(u) / weight with u
from a hash of its id and the child's name, and goes to the child with the
smallest. A child is so chosen in proportion to its weight, and raising a
child's weight only brings documents to it: between the other children nothing
moves, so movement stays inside the subtrees whose weights change. Weights of
inner nodes are the sums of their shards'.

``grow`` adds a shard as a region of its own, so that at each level the only
weight that changes is that of the new node: documents move to the new shard or
not at all.

The slots of a shard are numbered without gaps and without gathering a shard in
one place: a document's slot is its place among its own input task's documents
of that shard, plus the counts of the tasks before it.

Defined cases: null ids all go where the id "null" goes (a fixed place); equal
ids share a shard but have slots of their own; null text counts as no bytes and
has the CRC of the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm import common

#: region → rack → shard → weight
Tree = dict[str, dict[str, dict[int, float]]]


def regular(regions: int = 2, racks: int = 2, shards: int = 4, weight: float = 1.0) -> Tree:
    """Equal regions of equal racks; shards are numbered from 0."""
    return {f"region{g}": {f"rack{g}.{r}": {(g * racks + r) * shards + s: weight for s in range(shards)}
                           for r in range(racks)} for g in range(regions)}


def shard_numbers(tree: Tree) -> list[int]:
    return sorted(s for racks in tree.values() for shards in racks.values() for s in shards)


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a region and rack of its own."""
    new = max(shard_numbers(tree), default=-1) + 1
    return tree | {f"region+{new}": {f"rack+{new}": {new: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _descend(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The column of the child with the smallest draw; a child is (name, weight, column)."""
    children = [c for c in children if c[1] > 0]
    if len(children) == 1:
        return children[0][2]
    best = F.array_min(F.array(*[F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("child"))
                                 for i, (name, weight, _) in enumerate(children)]))["child"]
    out = F.when(best == 0, children[0][2])
    for i, (_, _, column) in enumerate(children[1:], 1):
        out = out.when(best == i, column)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of each key; expressions only."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions = []
    for region, racks in tree.items():
        inner = [(rack, sum(shards.values()), _descend(key, [(f"shard{s}", w, F.lit(s)) for s, w in shards.items()]))
                 for rack, shards in racks.items()]
        regions.append((region, sum(w for _, w, _ in inner), _descend(key, inner)))
    return _descend(key, regions)


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (null without ``grown``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    moved = shard_of(F.col(id_col), grown) if grown else F.lit(None)
    rows = common.materialise(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), shard_of(F.col(id_col), tree).alias("shard"),
        moved.cast("int").alias("grown_shard"), F.monotonically_increasing_id().alias("place")), "shards")
    rows = rows.withColumn("task", F.shiftright("place", 33))
    per_task = rows.groupBy("task", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("task", "shard").orderBy("place")) - 1
    return (rows.withColumn("own", own).join(bases, ["task", "shard"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("own")).alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, tree: Tree, path: str, id_col: str = "doc_id") -> None:
    """All columns of ``docs`` as Parquet below ``path/shard=N``."""
    docs.withColumn("shard", shard_of(F.col(id_col), tree)).write.partitionBy("shard").parquet(path)
