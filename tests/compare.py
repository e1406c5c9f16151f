"""Query results against DuckDB."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame) -> list[tuple]:
    """Rows of a pandas frame in an order and form of their own."""

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, float):
            return None if math.isnan(x) else x
        return tuple(map(plain, x)) if isinstance(x, list) else x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(repr(plain(x)) for x in r) for r in frame.itertuples(index=False)))


def sql(con: duckdb.DuckDBPyConnection, text: str):
    return pa.table(con.sql(text)).to_pandas()
