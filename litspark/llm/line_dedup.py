"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys, hashed to 128 bits, with the number of documents
that hold each and, where the run is the first to hold it, the largest of their
ids. Runs are bucketed and sorted by the hash, so joining two of them merges
their files without a shuffle. A new batch of documents is joined to the runs
there are (a merge join, the rows without a partner are its anti-join): keys
that no run holds are new and name their document, the others only add to the
count. The batch becomes a run of level 0; ``fanout`` runs of one level are
compacted into one run of the next.

``dedup_lines`` adds the documents in batches of descending ids, so the batch
that first holds a key also holds the document that keeps it. It then compacts
the runs to one, drops each line whose key is in ``min_docs`` documents or more
from all documents but that one, and returns the texts that stay.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in
lower case; keys shorter than ``min_chars`` code points never count.

Skew: counts are combined before they are shuffled. A key held by at least one
in ``HOT_SHARE`` of all (document, key) pairs is sent to the tasks, of which
there can be no more than ``HOT_SHARE``; its lines take no part in the shuffle by
key. Texts meet their dropped line numbers by document.

Defined cases: a null or empty text is one empty line; every row is a document
of its own, and rows that share a doc_id all keep a key if theirs is the largest
that holds it; a null doc_id is less than any other, and a key held under null
ids alone stays in all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm import common
from litspark.session import checkpoint_dir

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 4
HOT_SHARE = 1000
MAX_BUCKETS = 100_000
EDGES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h", "g"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(EDGES)), UPPER, LOWER)


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit("line"), F.col(key)).alias("g")]


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, g): one row per document and distinct key."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    rows = _given(docs, id_col, text_col).select("doc_id", F.explode(F.array_distinct(keys)).alias("_key"))
    return rows.select("doc_id", *_hashes("_key"))


def key_counts(keys: DataFrame, *by: str) -> DataFrame:
    """(h, g, docs, top) of rows of ``line_keys``, combined before the shuffle."""
    return keys.groupBy(*by, *HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))


class LineRuns:
    """The levelled runs; each is an external table of the session's catalog below ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: dict[int, list[str]] = defaultdict(list)
        self._paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = f"{checkpoint_dir(self.spark)}/{name}"
        (run.select(*HASH, "docs", "top").write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", self._paths[name]).format("parquet").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.remove(self.spark, self._paths.pop(name))

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in sorted(self.levels) for name in self.levels[level]]

    def mark(self, counts: DataFrame) -> DataFrame:
        """``counts`` (h, g, …) dealt like the runs, with ``is_new``: no run holds the key."""
        out, known = counts.repartition(self.buckets, *HASH), F.lit(False)
        for i, run in enumerate(self.tables()):
            out = out.join(run.select(*HASH, F.lit(True).alias(f"_in{i}")).hint("merge"), HASH, "left")
            known = known | F.col(f"_in{i}").isNotNull()
        return out.select(*counts.columns, (~known).alias("is_new"))

    def add(self, counts: DataFrame) -> None:
        """A batch's ``key_counts``: merged against the runs, then added as a run of its own."""
        marked = self.mark(counts).withColumn("top", F.when(F.col("is_new"), F.col("top")))
        self.levels[0].append(self._write(marked))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level, level + 1)
            level += 1

    def _summed(self, names: list[str]) -> DataFrame:
        """Several runs as one. Their files are read as one plain scan: a union of bucketed
        tables would pass for one that is dealt by its keys already."""
        rows = self.spark.read.schema("h long, g long, docs long, top long").parquet(*[self._paths[n] for n in names])
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def _compact(self, level: int, into: int) -> None:
        names = self.levels.pop(level)
        self.levels[into].append(self._write(self._summed(names)))
        for name in names:
            self._drop(name)

    def compacted(self) -> DataFrame:
        """All runs as one (which also becomes the only one); an empty table before the first batch."""
        if not self.tables():
            self.add(self.spark.createDataFrame([], "h long, g long, docs long, top long"))
        old, last = [n for names in self.levels.values() for n in names], max(self.levels)
        if len(old) > 1:
            merged = self._write(self._summed(old))
            for name in old:
                self._drop(name)
            self.levels = defaultdict(list, {last + 1: [merged]})
        return self.tables()[0]

    def drop(self) -> None:
        for name in list(self._paths):
            self._drop(name)
        self.levels.clear()


def new_lines(docs: DataFrame, runs: LineRuns, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(h, g, docs, top, is_new) of a new batch against the runs, without adding it."""
    return runs.mark(key_counts(line_keys(docs, min_chars, id_col, text_col)))


def _batched(docs: DataFrame, batches: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Key counts per batch; batch 0 has the largest ids, a null id is in the last."""
    low, high = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    low, high = low or 0, high or 0
    below = (F.lit(float(high)) - F.col("doc_id").cast("double")) * (batches / (high - low + 1))
    batch = F.coalesce(F.least(F.floor(below), F.lit(batches - 1)), F.lit(batches - 1)).cast("int")
    return key_counts(line_keys(docs, min_chars, id_col, text_col).withColumn("batch", batch), "batch")


def _dropped(docs: DataFrame, final: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, t, gone): per document the numbers of its dropped lines; t tells texts of one id apart."""
    total = final.agg(F.sum("docs")).first()[0] or 0
    common_keys = final.where(F.col("docs") >= min_docs).select("h", "g", "docs", "top")
    is_hot = F.col("docs") * HOT_SHARE >= F.lit(total)
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"),
                        F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("line", "_key"))
    lines = lines.where(F.length("_key") >= min_chars).select("doc_id", "t", "line", *_hashes("_key"))
    hot = F.broadcast(common_keys.where(is_hot).select("h", "g", F.col("top").alias("hot_top"), F.lit(True).alias("hot")))
    lines = lines.join(hot, HASH, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lines = lines.where(~F.col("hot") | ~F.col("doc_id").eqNullSafe(F.col("hot_top")))
    # a hot line is decided; its key is replaced by one that spreads it and meets nothing
    spread = lines.select("doc_id", "t", "line", "hot", F.when(F.col("hot"), F.xxhash64("doc_id", "t", "line")).otherwise(F.col("h")).alias("h"),
                          F.when(~F.col("hot"), F.col("g")).alias("g"))
    cold = common_keys.where(~is_hot).select("h", "g", "top", F.lit(True).alias("found"))
    decided = spread.join(cold.hint("merge"), HASH, "left").where(
        F.col("hot") | (F.col("found") & ~F.col("doc_id").eqNullSafe(F.col("top"))))
    return decided.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    spark = docs.sparkSession
    incoming = common.materialise(_batched(docs, batches, min_chars, id_col, text_col), "line-keys")
    runs = LineRuns(spark, fanout=fanout)
    for batch in range(batches):
        runs.add(incoming.where(F.col("batch") == batch).select(*HASH, "docs", "top"))
    given = _given(docs, id_col, text_col)
    gone = _dropped(given, runs.compacted(), min_chars, min_docs).select(
        F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), "gone")
    rows = given.withColumn("t", F.xxhash64("text")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")), "left")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "gone", lines_of(F.col("text")).alias("lines"))
    # the runs of lines between the dropped ones, so the work grows with the lines alone
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("lines", s + 1, e - s)))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, line, translate(trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 '{UPPER}', '{LOWER}') AS key, raw
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)),
common AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.top AS gone FROM lines l LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
