"""Line dedup against a plain count over all lines; the runs against a plain dictionary."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from litspark.llm import line_dedup
from tests.llm.conftest import CLASHING, messy_rows

FOLD = {c: c + 32 for c in range(65, 91)}


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def plain_dedup(docs, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    for doc, text in docs:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            if len(key) >= min_chars:
                holders[key].append(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")

        def gone(line):
            held = holders.get(key_of(line), [])
            return len(held) >= min_docs and doc != max(held, key=lambda d: (d is not None, d or 0))

        kept = [x for x in lines if not gone(x)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(
        {c: F.lit(c) for c in CLASHING + ["h", "g", "t", "gone", "lines", "hot", "docs", "top", "batch"]})


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


LONG = ["This line is long enough to count as a passage number %d of them" % i for i in range(12)] + ["É" * 40, "é" * 40, "É" * 39]


def random_docs(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [rng.choice([x, x.upper(), f"\t {x} \r", "short", "", f"own line of document {i}, which nobody else has at all"])
                 for x in rng.choices(LONG, k=rng.randint(0, 9))]
        out.append((i * 7 - 20, "\n".join(lines)))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_same_as_plain(spark, batches, fanout):
    docs = random_docs(batches, 80) + [(10_000, None), (10_001, ""), (10_002, "\n"), (10_003, "\n".join(LONG * 40))]
    assert rows_of(line_dedup.dedup_lines(frame(spark, docs), batches=batches, fanout=fanout)) == plain_dedup(docs)


def test_messy_rows(spark):
    docs = [r[:2] for r in messy_rows()] + [(None, LONG[0]), (None, LONG[0])] * 3 + [(50, LONG[1])] * 6 + [(49, LONG[1] + "\nx\n" + LONG[1])]
    assert rows_of(line_dedup.dedup_lines(frame(spark, docs))) == plain_dedup(docs)


def test_hot_lines_and_cold_ones(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 4)
    docs = [(i, LONG[0] + ("\n" + LONG[1 + i % 5] if i % 2 else "") + f"\n{i}") for i in range(60)]
    assert rows_of(line_dedup.dedup_lines(frame(spark, docs))) == plain_dedup(docs)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_runs(spark):
    """Every batch is marked against what the runs hold, and compaction keeps the counts."""
    runs, held = line_dedup.LineRuns(spark, buckets=3, fanout=2), {}
    for b in range(6):
        docs = frame(spark, random_docs(b, 15))
        counts = {(r["h"], r["g"]): r for r in line_dedup.new_lines(docs, runs).collect()}
        assert all(r["is_new"] == (key not in held) for key, r in counts.items())
        runs.add(line_dedup.key_counts(line_dedup.line_keys(docs)))
        for key, r in counts.items():
            n, top = held.get(key, (0, r["top"]))
            held[key] = n + r["docs"], top
        assert all(len(names) < 2 for names in runs.levels.values())
    assert {(r["h"], r["g"]): (r["docs"], r["top"]) for r in runs.compacted().collect()} == held
    runs.drop()
    assert not runs.tables()


def test_a_batch_meets_the_runs_without_moving_them(spark):
    runs = line_dedup.LineRuns(spark, buckets=4)
    counts = line_dedup.key_counts(line_dedup.line_keys(frame(spark, random_docs(1, 30))))

    def plan():
        return runs.mark(counts)._jdf.queryExecution().executedPlan().toString()

    alone = plan()
    runs.add(counts)
    runs.add(counts)
    assert "SortMergeJoin" in plan() and plan().count("Exchange") == alone.count("Exchange")
    runs.drop()
