"""Side-by-side comparison of a query with its SQL in DuckDB, as sorted rows by column name."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(value: object) -> object:
    if hasattr(value, "tolist"):
        value = value.tolist()
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as connection:
        for path in Path(folder).glob("*.parquet"):
            connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        found = connection.sql(sql)
        names = found.columns
        order = [names.index(n) for n in sorted(names)]
        return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
