"""Many names in many texts: Aho-Corasick automata over blocks of names.

Every task runs its texts through one automaton, so a text costs its own length and
its matches, however many names there are. The names are read in blocks of at most
``block_chars`` characters. Only one block is held at a time, by the driver and by
each Python worker; a longer list means more passes over the texts, never a larger
broadcast. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_CHARS = 8 << 20
OUT_ROWS = 10_000


def name_blocks(names: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[dict[str, list[str]]]:
    """Lower-case form → names, in bounded blocks, read one partition at a time."""
    block: dict[str, list[str]] = {}
    size = 0
    for name, low in names.select("name", F.lower("name")).toLocalIterator():
        if block and size + len(low) > block_chars:
            yield block
            block, size = {}, 0
        block.setdefault(low, []).append(name)
        size += len(low) + 1
    if block:
        yield block


def automaton(names: dict[str, list[str]]):
    """Finds the names of a block; null without any that has a character."""
    import ahocorasick
    out = ahocorasick.Automaton()
    for low, found in names.items():
        if low:
            out.add_word(low, found)
    if not len(out):
        return None
    out.make_automaton()
    return out


def _names_in(text: str | None, finder, always: list[str]) -> list[str]:
    if text is None:
        return []
    found = {} if finder is None else {id(names): names for _, names in finder.iter(text)}
    return always + [name for names in found.values() for name in names]


def find_all(df: DataFrame, text_col: str, names: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``df`` paired with every one of ``names`` (distinct, not null, column ``name``) whose
    lower-case form is in the lower-cased ``text_col``. An empty name is in every text that is not null."""
    spark, out = df.sparkSession, None
    # a column called name gives way, as with ``withColumn``
    rows = df.select(*[c for c in df.columns if c != "name"], F.lower(F.col(text_col)).alias("_low"))  # Spark's lower case on both sides
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("name", T.StringType())])
    for block in name_blocks(names, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder, always = automaton(shared.value), shared.value.get("", [])
            for batch in batches:
                at_rows, found = [], []
                for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    names = _names_in(text, finder, always)
                    at_rows += [row] * len(names)
                    found += names
                own = batch.select(range(batch.num_columns - 1))
                for at in range(0, len(at_rows), OUT_ROWS):
                    part = own.take(pa.array(at_rows[at: at + OUT_ROWS], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found[at: at + OUT_ROWS], pa.string())],
                                                     names=schema.names)

        part = rows.mapInArrow(match, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
