import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from litspark.llm import sharding as S


def shards(spark, tree, n=20_000):
    return np.array([r[0] for r in spark.range(n).select(S.shard_of(F.col("id"), tree)).orderBy("id").collect()])


def test_growing_takes_rows_only_into_the_new_shard(spark):
    tree = S.regular()
    for _ in range(3):
        more = S.grow(tree)
        a, b = shards(spark, tree), shards(spark, more)
        moved = a != b
        n = len(S.shard_numbers(more))
        assert (b[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.01
        tree = more


def test_shares_follow_the_weights(spark):
    tree = {"a": {"a1": {0: 1.0, 1: 2.0}, "a2": {2: 3.0}}, "b": {"b1": {3: 4.0, 4: 0.0}}}
    count = Counter(shards(spark, tree).tolist())
    assert count[4] == 0 and all(abs(count[s] / 20_000 - w / 10) < 0.015 for s, w in ((0, 1), (1, 2), (2, 3), (3, 4)))


def test_movement_stays_inside_the_changed_subtree(spark):
    tree = S.regular(2, 2, 2)  # region 0: shards 0-3, region 1: shards 4-7
    heavy = {**tree, "region1": {**tree["region1"], "rack1.0": {4: 3.0, 5: 1.0}}}
    a, b = shards(spark, tree), shards(spark, heavy)
    moved = a != b
    region, rack = lambda s: s // 4, lambda s: s // 2
    assert moved.any() and (region(b[moved]) == 1).all()
    inside = moved & (region(a) == 1)
    assert (rack(b[inside]) == 2).all() and (b[inside & (rack(a) == 2)] == 4).all()


def test_rows_slots_and_digests(spark, messy, nothing):
    tree = S.regular()
    out = S.assign(messy, tree, S.grow(tree))
    rows = out.collect()
    given = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in messy.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == given
    by, places = defaultdict(set), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        places[r["shard"]].append(r["slot"])
    assert all(len(v) == 1 for v in by.values()) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert S.assign(nothing, tree).count() == 0


def test_a_hot_id_gets_gapless_slots(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text")).repartition(7)
    places = defaultdict(list)
    for r in S.assign(docs, S.regular()).collect():
        places[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and sum(map(len, places.values())) == 3000


def test_written_shards_hold_every_row(spark, messy, tmp_path):
    S.write_shards(messy.drop("shard"), S.regular(), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == messy.count()


def plain_shard(key, tree):
    """The descent in plain Python: the smallest draw at every level."""
    import math
    import xxhash

    def draw(name, weight):
        first = xxhash.xxh64_intdigest(key.encode(), seed=42)
        bits = xxhash.xxh64_intdigest(name.encode(), seed=first) >> 11
        return -math.log((bits + 0.5) / (1 << 53)) / weight

    def weight(node):
        return sum(weight(x) for x in node.values()) if isinstance(node, dict) else node

    def descend(node):
        names = [k for k in node if weight(node[k]) > 0]
        best = names[0] if len(names) == 1 else min(names, key=lambda k: draw(f"shard{k}" if isinstance(k, int) else k, weight(node[k])))
        return descend(node[best]) if isinstance(node[best], dict) else best

    return descend(tree)


def test_draws_recomputed_in_plain_python(spark):
    from litspark.llm import sharding
    from pyspark.sql import functions as F
    uneven = {"a": {"x": {0: 1.0, 1: 5.0}, "y": {2: 0.5}}, "b": {"z": {3: 2.0, 4: 0.0, 5: 1.5}}}
    for tree in (sharding.regular(), sharding.grow(sharding.regular()), uneven):
        rows = spark.range(-200, 1200).select("id", sharding.shard_of(F.col("id"), tree).alias("shard")).collect()
        assert {r["id"]: r["shard"] for r in rows} == {r["id"]: plain_shard(str(r["id"]), tree) for r in rows}
