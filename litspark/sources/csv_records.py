"""Multi-line CSV records from files that are cut anywhere.

Spark's own multi-line reader takes a file as one task. Here the files are read as
lines, in as many splits as their bytes ask for, and a line is a step of a machine
with two states: at its start a record begins, or a quoted field goes on. A first
pass reduces each split to what it does to either state. Running those steps per
file (a window over one row per split) tells the state in which each split begins.
A second pass then cuts each split into records; the parts of a record that spans
splits are put together by file.

Line ends are ``\\n`` or ``\\r\\n``. A quote opens a quoted field only at the start of a
field, as in Spark's reader; inside one, a doubled quote stands for a quote.
Compressed files cannot be split and stay one task each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
_REST = rf"(?:,{_FIELD})*+\Z"
#: a line that ends outside quotes, from the start of a record or from inside a quoted field
_WHOLE = re.compile(_FIELD + _REST)
_CLOSES = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+' + _REST)


def stays_quoted(line: str, quoted: bool) -> bool:
    """Whether the line's end is inside a quoted field."""
    if '"' not in line:
        return quoted
    return not (_CLOSES if quoted else _WHOLE).match(line)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line) of every split, its lines in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple]:
    """(file, block, line, extra columns…) row by row; a task may hold several splits, one after another."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line", *extra)))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: whether it ends quoted when it begins outside of and inside quotes."""
    ends: dict[tuple[str, int], tuple[bool, bool]] = {}
    for file, block, line in _by_split(batches):
        plain, quoted = ends.get((file, block), (False, True))
        if '"' in line:
            both = {state: stays_quoted(line, state) for state in {plain, quoted}}
            plain, quoted = both[plain], both[quoted]
        ends[file, block] = plain, quoted
    columns = list(zip(*[(*key, *value) for key, value in ends.items()])) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
                                     names=["file", "block", "plain", "quoted"])


def quoted_starts(lines: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted field."""
    steps = lines.mapInArrow(_steps, "file string, block long, plain boolean, quoted boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, flips = F.col("plain") == F.col("quoted"), (F.col("plain") & ~F.col("quoted")).cast("long")
    # the state after the last split that fixes it, turned over by every split since that flips it
    turned = steps.withColumn("turns", F.sum(flips).over(Window.partitionBy("file").orderBy("block")))
    last = F.max(F.when(fixed, F.struct("block", "plain", "turns"))).over(before)
    states = turned.select("file", "block", last.alias("last"), F.sum(flips).over(before).alias("flips"))
    since = F.coalesce("flips", F.lit(0)) - F.coalesce("last.turns", F.lit(0))
    return states.where(F.coalesce("last.plain", F.lit(False)) != (since % 2 == 1)).select("file", "block")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, place, text): ``place`` is null for a whole record, 0 for the end of a record that
    began in an earlier split, 1 for one that goes on in the next. A file's first record has block -1."""
    rows: list[tuple] = []
    key, held, quoted, foreign, header = None, [], False, False, False

    def flush(file: str, block: int, place: int | None) -> None:
        nonlocal header
        text = "\n".join(held)
        if place is None:
            text = text.removesuffix("\r")
        if text or place is not None:
            rows.append((file, -1 if header else block, place, text))
            header = False

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))],
                                          names=["file", "block", "place", "record"])

    for file, block, line, starts_quoted in _by_split(batches, "quoted"):
        if key != (file, block):
            if held:
                flush(*key, 0 if foreign else 1)
            key, held, quoted, foreign, header = (file, block), [], starts_quoted, starts_quoted, block == 0
        held.append(line)
        quoted = stays_quoted(line, quoted)
        if not quoted:
            flush(file, block, 0 if foreign else None)
            held, foreign = [], False
        if len(rows) >= 1000:
            yield batch()
    if held:
        flush(*key, 0 if foreign else 1)
    yield batch()


def csv_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(record) of every CSV record below ``path``, without each file's first one if it is a ``header``.
    Empty lines between records are skipped."""
    lines = _lines(spark, path)
    # one row per split that begins inside quotes: bounded by the number of splits
    starts = F.broadcast(quoted_starts(lines).withColumn("quoted", F.lit(True)))
    pieces = lines.join(starts, ["file", "block"], "left").select("file", "block", "line", F.coalesce("quoted", F.lit(False)).alias("quoted")
                                                                  ).mapInArrow(_cut, "file string, block long, place int, record string")
    if header:
        pieces = pieces.where((F.col("block") >= 0) | F.col("place").isNotNull())
    whole = pieces.where(F.col("place").isNull()).select("record")
    order = Window.partitionBy("file").orderBy("block", "place")
    parts = pieces.where(F.col("place").isNotNull()).withColumn("number", F.sum("place").over(order))
    joined = parts.groupBy("file", "number").agg(
        F.min("block").alias("first"), F.sort_array(F.collect_list(F.struct("block", "place", "record"))).alias("parts"))
    if header:
        joined = joined.where(F.col("first") >= 0)
    text = F.regexp_replace(F.array_join(F.col("parts.record"), "\n"), r"\r\z", "")
    return whole.unionByName(joined.select(text.alias("record")))
