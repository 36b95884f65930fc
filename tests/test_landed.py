"""Page chains, numbered lines and VARIANT records against plain versions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from litspark.operators import variant
from litspark.sources import chain


def plain_chain(pages):
    landed = {}
    for cursor, after in pages:
        if cursor is not None:
            known = landed.get(cursor)
            landed[cursor] = min((x for x in (known, after) if x is not None), default=None)
    before = {}
    for cursor, after in landed.items():
        if after is not None:
            before.setdefault(after, []).append(cursor)
    out = []
    for cursor, after in landed.items():
        at, steps, seen = cursor, 0, {cursor}
        while at in before:
            at, steps = min(before[at]), steps + 1
            if at in seen:
                at = None
                break
            seen.add(at)
        out.append((cursor, after, at, steps if at is not None else None, len(before.get(cursor, [])), after is not None and after not in landed))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_page_chain(spark, seed):
    rng = random.Random(seed)
    names = [f"p{i:02d}" for i in range(45)]
    pages = [(a, rng.choice([b, b, b, None, "gone", rng.choice(names)])) for a, b in zip(names, names[1:] + [None])] + [("p03", "p01"), (None, "p02")]
    rng.shuffle(pages)
    got = chain.page_chain(spark.createDataFrame(pages, "cursor string, next_cursor string"))
    assert sorted(map(tuple, got.collect())) == plain_chain(pages)


def test_chain_of_one_and_of_none(spark):
    empty = spark.createDataFrame([], "cursor string, next_cursor string")
    assert chain.page_chain(empty).count() == 0
    assert [tuple(r) for r in chain.page_chain(spark.createDataFrame([("a", None)], empty.schema)).collect()] == [("a", None, "a", 0, 0, False)]
    assert [tuple(r) for r in chain.page_chain(spark.createDataFrame([("a", "a")], empty.schema)).collect()] == [("a", "a", None, None, 1, False)]


def test_lines_are_numbered_across_files_and_splits(spark, tmpdir_path):
    want = []
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = [f"{name} {i} " + "x" * (i % 37) for i in range(300)]
        want += lines
        with open(os.path.join(tmpdir_path, name), "w") as fh:
            fh.write("\n".join(lines) + "\n")
    keys = {"spark.sql.files.maxPartitionBytes": "777", "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = {r["row"]: r["line"] for r in chain.numbered_lines(spark, tmpdir_path).collect()}
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_aligned_rows_tell_which_side_is_longer(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "row long, line string")
    b = spark.createDataFrame([(0, "1")], "row long, line string")
    assert sorted(map(tuple, chain.align_lines(a, b).collect())) == [(0, "x", "1", "both"), (1, "y", None, "left"), (2, None, None, "left")]
    assert [r["side"] for r in chain.align_lines(b.limit(0), b).collect()] == ["right"]


def body(group, year="2021"):
    return json.dumps({"abstracts-retrieval-response": {"item": {"ait:process-info": {"ait:date-delivered": {"@year": year}}, "bibrecord": {
        "head": {"author-group": group, "abstracts": "About", "citation-title": "T"}}}}})


def test_variant_records(spark):
    def org(value):
        return {"affiliation": {"organization": value}}

    cases = [(org({"$": "one"}), "one"), (org([{"$": "a"}, {"$": "last"}]), "last"), ([org(None), org([{"$": ""}]), org({"$": "third"})], "third"),
             ([], None), (None, None), ("text", None), ({"affiliation": {}}, None), (org([]), None), ([{"other": 1}], None)]
    rows = [(str(i), body(group)) for i, (group, _) in enumerate(cases)] + [("broken", "{"), ("null", None), ("number", "3")]
    out = {r["filename"]: r for r in variant.flatten_records(variant.parse(spark.createDataFrame(rows, "filename string, body string"))).collect()}
    assert [out[str(i)]["organization"] for i in range(len(cases))] == [want for _, want in cases]
    assert out["0"]["year"] == 2021 and out["0"]["title"] == "T" and out["broken"]["title"] is out["null"]["year"] is out["number"]["title"] is None
    kinds = variant.schema_profile(variant.parse(spark.createDataFrame(rows, "filename string, body string")), paths={"g": f"{variant.HEAD}['author-group']"})
    assert {r["kind"]: r["n_records"] for r in kinds.collect()} == {"OBJECT": 4, "ARRAY": 3, "VOID": 1, "STRING": 1, "missing": 3}
