"""Batches handed to Python stay small; the record tree is written without a join and by many tasks."""

import glob
import json
import os

import pyarrow as pa
import pytest

from litspark import fixtures
from litspark.functions import text as T
from litspark.plans import queries_landed
from litspark.session import small_file_tasks
from litspark.sources import files, html_tree, sinks

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_trees_leave_python_in_small_batches():
    page = "<article><p class='a'>x &amp; y</p></article>"
    pages = [page + " " * 300_000, None, "", *[page] * 40, page + " " * (3 << 20), page]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), pa.array(pages)], names=["page_id", "html"])
    got = list(html_tree.parse_batch(pa.RecordBatch.from_pylist(batch.to_pylist() * 8, schema=batch.schema)))
    assert len(got) > 8
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == [*range(len(pages))] * 8
    assert [len(r["elements"]) for r in rows] == [0 if not p else 2 for p in pages] * 8
    assert [r["text"] for r in rows] == [p and html_tree.parse(p)[0] for p in pages] * 8
    assert not list(html_tree.parse_batch(batch.slice(0, 0)))


def test_pages_reach_python_in_bounded_batches(spark):
    before = spark.conf.get(ARROW_ROWS)
    pages = spark.range(5000).selectExpr("id AS page_id", "concat('<p>', id, ' &lt;', if(id % 2 = 0, '</p>', '')) AS html").coalesce(1)
    try:
        for use in (lambda: pages.select("page_id", T.clean_paragraphs(T.clean_html("html")).alias("text")),
                    lambda: html_tree.parse_pages(pages).selectExpr("page_id", "text")):
            spark.conf.set(ARROW_ROWS, "10000")
            rows = use().collect()
            assert int(spark.conf.get(ARROW_ROWS)) <= 1000
            assert {r["page_id"]: r["text"].rstrip("<").strip() for r in rows} == {i: str(i) for i in range(5000)}
    finally:
        spark.conf.set(ARROW_ROWS, before)


def test_record_files_are_one_row_each_without_a_join(spark, tmpdir_path):
    docs = [(1, "t1\nx", "s1", "en"), (1, "t1\nx", "s1", "en"), (2, None, "s2", "de"), (7, "seven", "a/b", "en"), (8, "n", None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmpdir_path}/documents.parquet")
    files = queries_landed._record_files(spark, tmpdir_path)
    assert "Join" not in files._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["source"], r["number"]) for r in files.collect()) == [("a/b", 7), ("s1", 1), ("s1", 1), ("s2", 2)]
    got = sorted(map(tuple, queries_landed.q_json_tree(spark, tmpdir_path).collect()), key=str)
    assert [(g[0], g[1], g[2].split("/")[-1]) for g in got] == [(False, None, "number=7"), (True, "t1", "number=1"), (True, None, "number=2")]
    assert fixtures.records_json(spark, tmpdir_path).count() == 5


def _tree(path):
    found = [f for f in glob.glob(f"{path}/**/*", recursive=True, include_hidden=True) if os.path.isfile(f)]
    found = [f for f in found if not f.endswith(".crc") and not f.endswith("/_SUCCESS")]
    return sorted((os.path.dirname(os.path.relpath(f, path)), open(f, "rb").read()) for f in found)


def test_a_tree_of_files_is_that_of_sparks_writer(spark, tmpdir_path):
    odd = "".join(map(chr, range(1, 128))) + "é\u3042"
    rows = [(odd, 1, "x"), ("a/b", 2, "two\nlines"), ("a/b", 2, "two\nlines"), (None, 3, "é"), ("", 3, None), ("c", None, ""), *[(f"s{i % 7}", i, str(i)) for i in range(300)]]
    df = spark.createDataFrame(rows, "source string, number long, value string")
    sinks.write_tree(df, f"file:{tmpdir_path}/now", ["source", "number"])
    df.repartition("source", "number").write.partitionBy("source", "number").format("text").save(f"{tmpdir_path}/spark")
    got = _tree(f"{tmpdir_path}/now")
    # (null and "" share a folder: the order of its lines is not Spark's to promise)
    assert [(d, sorted(t.split(b"\n"))) for d, t in got] == [(d, sorted(t.split(b"\n"))) for d, t in _tree(f"{tmpdir_path}/spark")]
    assert len(got) == 304 and all(os.path.basename(f) == "part-00000.txt" for f in glob.glob(f"{tmpdir_path}/now/*/*/*", include_hidden=True))
    with pytest.raises(FileExistsError):
        sinks.write_tree(df, f"{tmpdir_path}/now", ["source", "number"])
    sinks.write_tree(df.limit(0), f"{tmpdir_path}/none", ["source", "number"])
    assert _tree(f"{tmpdir_path}/none") == [] and files.read_json_tree(spark, f"{tmpdir_path}/none", glob="part-*")[0].collect() == []


def test_a_failed_task_leaves_no_half_file(tmpdir_path):
    def batches():
        yield pa.RecordBatch.from_pydict({"k": ["a", "b"], "value": ["1", "2"]})
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        list(sinks._tree_writer(tmpdir_path, ["k"])(batches()))
    assert _tree(tmpdir_path) == [("k=a", b"1\n")]


def test_many_small_files_are_read_by_few_tasks(spark, tmpdir_path):
    most = small_file_tasks(spark)
    for i in range(3 * most):
        os.makedirs(f"{tmpdir_path}/t/{i}")
        with open(f"{tmpdir_path}/t/{i}/r.json", "w") as f:
            f.write("{" if i % 3 == 0 else json.dumps({"abstracts-retrieval-response": {}}))
    key, listing = "spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, listed = spark.conf.get(key), spark.conf.get(listing)
    try:
        spark.conf.set(key, str(1 << 30))  # a partition for each file
        good, bad = files.read_json_tree(spark, f"{tmpdir_path}/t")
        assert good.rdd.getNumPartitions() <= most and bad.rdd.getNumPartitions() <= most
        assert (len(good.collect()), len(bad.collect())) == (2 * most, most)
    finally:
        spark.conf.set(key, before)
    assert spark.conf.get(listing) == listed
