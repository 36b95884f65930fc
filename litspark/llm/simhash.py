"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A document's 64-bit fingerprint is the majority bit of the XXH64 values of its
word shingles. Two fingerprints are linked at ``radius`` or fewer differing
bits. Bit i is given a nonzero vector phi(i) of radius + 1 bits; table v (any
nonzero vector) compares the bits with <phi(i), v> = 1. For any ``radius``
differing bits there is a v orthogonal to all their vectors, so every pair
within the radius agrees in at least one of the 2^(radius+1) - 1 tables: no
link is missed, and every one is verified bit by bit.

Copies collapse to one row per fingerprint before any table is built. A bucket
is walked breadth-first against its fingerprints not yet reached, which links a
crowd of near copies in few passes and emits at most one link per member. A
bucket over ``BUCKET_ROWS`` fingerprints is not held: its fingerprints are
linked through all points within radius/2 bits (two fingerprints within an even
radius share such a point, and any two that share one are within it), where a
point has at most 2081 fingerprints for radius 4.

Defined cases: null or wordless texts have the fingerprint 0 and are linked
like any other; texts with fewer words than a shingle hash the whole sequence;
a component's id is its smallest non-null doc_id, null if it has none; repeated
rows are each returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm import common
from litspark.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Fingerprints of one bucket that a task holds at once (8 bytes each).
BUCKET_ROWS = 1 << 16
#: A key with more than one in so many of a table's rows is a crowd: at most so many keys are.
CROWD = 1000


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return hash64(joined, SEED)
    hashes = np.array([hash64(joined[s:e], SEED) for s, e in zip(starts, ends[words_per_shingle - 1:])], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask per nonzero vector of radius + 1 bits."""
    vectors = (1 << (radius + 1)) - 1
    phi = [1 + i % vectors for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp as a signed long."""
    common.bound_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(t, words_per_shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(hashed, "doc_id long, fp long")


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links (member, root) of the components within one bucket."""
    links: list[tuple[int, int]] = []
    rest = np.sort(fps)
    while len(rest) > 1:
        root, rest, queue = int(rest[0]), rest[1:], [rest[0]]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                queue.extend(found)
                links += [(int(f), root) for f in found]
    return links


def _walk(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, key); one bucket is held at a time, at most ``most`` rows of it."""
    held: list[np.ndarray] = []
    count, current, crowded = 0, None, False

    def links() -> list[tuple[int, int | None]]:
        return bucket_links(np.concatenate(held).view(np.uint64), radius) if count > 1 else []

    def batch_of(rows: list[tuple[int, int | None]]) -> pa.RecordBatch:
        wrap = lambda x: None if x is None else x - (1 << BITS) if x >> (BITS - 1) else x
        return pa.RecordBatch.from_arrays([pa.array([wrap(a) for a, _ in rows], pa.int64()),
                                           pa.array([wrap(b) for _, b in rows], pa.int64())], names=["a", "b"])

    for batch in batches:
        slot, key, fps = (batch.column(i).to_numpy() for i in range(3))
        if not len(fps):
            continue
        cuts = np.flatnonzero((np.diff(slot) != 0) | (np.diff(key) != 0)) + 1
        out: list[tuple[int, int | None]] = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
            name = (slot[lo], key[lo])
            if name != current:
                if not crowded:
                    out += links()
                held, count, current, crowded = [], 0, name, False
            part = fps[lo:hi]
            if not crowded and count + len(part) > most:
                crowded = True
                out += [(int(f), None) for h in held for f in h.view(np.uint64)]
                held = []
            if crowded:
                out += [(int(f), None) for f in part.view(np.uint64)]
            else:
                held.append(part.copy())
                count += len(part)
        if out:
            yield batch_of(out)
    if not crowded and count > 1:
        yield batch_of(links())


def _ball(batches: Iterator[pa.RecordBatch], flips: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for fp in fps:
            yield pa.RecordBatch.from_arrays([pa.array((fp.view(np.uint64) ^ flips).view(np.int64)),
                                              pa.array(np.full(len(flips), fp))], names=["point", "fp"])


def crowd_links(crowd: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of fingerprints in crowded buckets through their common mid points."""
    half = radius // 2
    flips = np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(BITS), k)], np.uint64)
    points = crowd.mapInArrow(lambda b: _ball(b, flips), "point long, fp long")
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top")
    exact = points.join(hubs, "point").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return exact.distinct()


def near_links(distinct_fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that join every two fingerprints of ``distinct_fps(fp)`` within
    ``radius`` bits, through other such links or directly."""
    if radius % 2:
        raise ValueError("radius must be even: crowded buckets are linked through mid points")
    masks = covering_masks(radius)
    keyed = distinct_fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("slot", "key"))
    dealt = keyed.repartition("slot", "key").sortWithinPartitions("slot", "key").select("slot", "key", "fp")
    found = common.materialise(dealt.mapInArrow(lambda b: _walk(b, radius, bucket_rows), "a long, b long")
                               .distinct(), "simhash-links")
    crowd = found.where("b IS NULL").select("a").distinct()
    links = found.where("b IS NOT NULL")
    return links.unionByName(crowd_links(crowd, radius)) if crowd.take(1) else links


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
                    bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``; root: the
    fingerprint that stands for the component."""
    prints = common.materialise(fingerprints(docs, words_per_shingle, id_col, text_col)
                                .withColumn("part", F.spark_partition_id()), "simhash")
    least = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected_components(near_links(least.select("fp"), radius, bucket_rows))
    member = roots.select(F.col("vertex").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = common.materialise(member.join(least.drop("n"), "fp"), "simhash-linked")
    lowest = common.materialise(linked.groupBy("root").agg(F.min("least").alias("lowest"), F.count("*").alias("n")), "simhash-lowest")
    moved = meet(linked, lowest, "root").select("fp", "root", "lowest")
    component = common.materialise(least.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "least").alias("component_id"), "n"), "simhash-components")
    return meet(prints, component, "fp", "part").select("doc_id", "fp", "root", "component_id")


def meet(rows: DataFrame, facts: DataFrame, key: str, spread: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per ``key`` and in ``n`` its
    number of rows. Crowds, at most ``CROWD`` keys, are broadcast and their rows stay where they
    are. Another key meets its facts once per value of ``spread``, its rows after that."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    crowds = F.broadcast(facts.where(F.col("n") * CROWD > F.lit(total)).drop("n"))
    rest, known, on = rows.join(crowds.select(key), key, "left_anti"), facts.drop("n"), [key]
    if spread:
        on = [spread, key]
        known = rest.select(on).distinct().join(known, key)
    return rows.join(crowds, key).unionByName(rest.join(known, on))


def hex_print(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per component, the one with the smallest id; columns
    unchanged. Of repeated rows with that id and fingerprint one stays. Repeats are
    dropped inside each task before the text is shuffled, so that a row repeated
    without end reaches the final task once per input task."""
    groups = near_duplicates(docs, words_per_shingle, radius, id_col=id_col, text_col=text_col)
    keepers = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # where no row of a component has an id, or two rows share it, the smallest fingerprint stays
    mark, key = common.free_name(docs, "near_key"), F.concat_ws("/", F.coalesce(F.col("component_id").cast("string"), F.lit("-")), F.col("fp"))
    keepers = (keepers.groupBy("root", "component_id").agg(F.min("fp").alias("fp")).select(key.alias(mark)).distinct())
    ids, texts = docs.columns.index(id_col), docs.columns.index(text_col)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keys, first = [], []
            for i, text in zip(batch.column(ids).to_pylist(), batch.column(texts).to_pylist()):
                name = f"{'-' if i is None else i}/{signed(fingerprint(text, words_per_shingle))}"
                first.append(name not in seen)
                seen.add(name)
                keys.append(name)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*batch.schema.names, mark])
            yield out.filter(pa.array(first, pa.bool_()))

    schema = docs.limit(0).withColumn(mark, F.lit("")).schema
    return (docs.mapInArrow(keyed, schema).join(keepers, mark, "left_semi").dropDuplicates([mark]).drop(mark))
