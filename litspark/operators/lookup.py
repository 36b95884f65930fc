"""Size-checked access to small lookup tables.

A lookup table (topic words, country names, region lists) is inlined into a
plan as literals only when its row count is proven to be under a bound. Above
the bound the callers switch to a join strategy that does not put the table on
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows a lookup may have to become literals of a plan; literals are compiled
#: into generated code, so the bound is small.
DEFAULT_INLINE_ROWS = 500
#: Values an inline VALUES table may have; each is one query parameter.
MAX_VALUES = 2_000


def bounded_rows(df: DataFrame, max_rows: int = DEFAULT_INLINE_ROWS) -> list | None:
    """Rows of ``df`` if there are at most ``max_rows`` of them, else None.

    Only ``max_rows + 1`` rows are ever fetched, so an unexpectedly large
    table costs one small job and never lands on the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return rows


def scalar(df: DataFrame):
    """First column of a one-row aggregate."""
    row = df.first()
    return None if row is None else row[0]


def at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (counted on the executors)."""
    return df.limit(max_rows + 1).count() <= max_rows


def local_table(spark: SparkSession, rows: list, columns: list[tuple[str, str]]) -> DataFrame:
    """Driver-side rows (model- or parameter-sized) as an inline VALUES table.

    The result is a LocalRelation: scanning it runs no job, limits and counts
    on it are answered on the driver, and Catalyst knows its size, so a join
    to it is broadcast. (``createDataFrame`` from a list would be an RDD scan
    with unknown size.) Values are bound as query parameters, never spliced
    into the SQL text; beyond ``MAX_VALUES`` values the rows are parallelised.
    """
    ddl = ", ".join(f"`{name}` {dtype}" for name, dtype in columns)
    if not rows or len(rows) * len(columns) > MAX_VALUES:
        return spark.createDataFrame([tuple(r) for r in rows], ddl)
    args, tuples = {}, []
    for i, row in enumerate(rows):
        marks = []
        for j, value in enumerate(row):
            args[f"p{i}_{j}"] = value
            marks.append(f":p{i}_{j}")
        tuples.append("(" + ", ".join(marks) + ")")
    aliases = ", ".join(f"c{j}" for j in range(len(columns)))
    select = ", ".join(f"CAST(c{j} AS {dtype}) AS `{name}`" for j, (name, dtype) in enumerate(columns))
    return spark.sql(f"SELECT {select} FROM VALUES {', '.join(tuples)} AS v({aliases})", args=args)
