"""Runs registered queries next to their SQL in DuckDB and compares schema and values."""

import glob
import math
import os
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)


def duckdb_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    relation = connection.sql(sql)
    names = sorted(relation.columns)
    picked = ", ".join(f'"{n}"' for n in names)
    return names, sorted(connection.execute(f"SELECT {picked} FROM ({sql})").fetchall(), key=_key)


def differences(df, connection, sql: str) -> list[str]:
    """Empty when both give the same columns and the same bag of rows."""
    names, ours = spark_rows(df)
    sql_names, theirs = duckdb_rows(connection, sql)
    if names != sql_names:
        return [f"columns {names} against {sql_names}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows against {len(theirs)}"]
    found = []
    for a, b in zip(ours, theirs):
        if a != b:
            found.append(f"{dict(zip(names, a))} against {dict(zip(names, b))}")
        elif any(isinstance(v, float) and math.copysign(1, v) < 0 and v == 0 for v in (*a, *b)):
            found.append(f"negative zero in {a}")
        elif [type(v) for v in a] != [type(v) for v in b]:
            found.append(f"types {[type(v) for v in a]} against {[type(v) for v in b]}")
    return found


def run(spark, queries, oracles, folder: str, names=None) -> None:
    connection = connect(folder)
    for name in names or queries:
        begin = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                found = differences(df, connection, oracles[name])
                verdict = "same" if not found else f"DIFFERENT in {len(found)}: {found[:2]}"
            else:
                verdict = f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {verdict} ({time.time() - begin:.1f} s)", flush=True)
