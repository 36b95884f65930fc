"""Spark query vs DuckDB oracle: row count, column names, order-free value hash."""

from __future__ import annotations

import hashlib

import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v) -> str:
    if v is None:
        return "∅"
    try:
        if pd.isna(v):
            return "∅"
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    return str(v)


def rows_of(df) -> pd.DataFrame:
    """The rows of a Spark frame with whole numbers kept whole where others are null."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def digest(df: pd.DataFrame) -> tuple[str, list[str]]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v) for v in rec) for rec in df[cols].itertuples(index=False, name=None))
    return hashlib.sha1("\n".join(rows).encode()).hexdigest(), rows


def _whole_again(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> pd.DataFrame:
    """``toPandas`` makes floats of whole numbers beside nulls, DuckDB keeps them whole: where the oracle's
    column is whole with nulls, Spark's is too, unless a value of it is not whole."""
    out = spark_pdf.copy(deep=False)
    for c in out.columns:
        if str(oracle_pdf[c].dtype) == "Int64" and str(out[c].dtype) == "float64":
            try:
                out[c] = out[c].astype("Int64")
            except TypeError:  # a fraction: left to differ
                pass
    return out


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return False, f"columns {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"rows {len(spark_pdf)} vs {len(oracle_pdf)}"
    hs, rs = digest(_whole_again(spark_pdf, oracle_pdf))
    ho, ro = digest(oracle_pdf)
    if hs != ho:
        only_s = sorted(set(rs) - set(ro))[:2]
        only_o = sorted(set(ro) - set(rs))[:2]
        return False, f"values differ: spark-only {only_s} oracle-only {only_o}"
    return True, "ok"
