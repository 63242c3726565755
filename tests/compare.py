"""Run the registered queries against their SQL and compare rows and types."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v) if v is not None else (True, "", "") for v in row)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a query and its SQL, by column name and without row order."""
    names = sorted(spark_df.columns)
    kinds = {n: KINDS.get(t, t) for n, t in spark_df.dtypes}
    relation = con.sql(sql)
    other = dict(zip(relation.columns, map(str, relation.types), strict=True))
    if sorted(other) != names:
        return [f"columns {names} != {sorted(other)}"]
    out = [f"{n}: {kinds[n]} != {other[n]}" for n in names if kinds[n] != other[n]]
    ours = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=_key)
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(con.sql(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_key)
    if len(ours) != len(theirs):
        return [*out, f"rows {len(ours)} != {len(theirs)}"]
    wrong = 0
    for a, b in zip(ours, theirs, strict=True):
        for n, x, y in zip(names, a, b, strict=True):
            same = x == y or (
                isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)
            )
            if not same:
                wrong += 1
                if wrong <= 4:
                    out.append(f"{n}: {x!r} != {y!r} in {str(a)[:120]}")
    if wrong:
        out.append(f"{wrong} values differ of {len(ours)} rows")
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            if name in sqls:
                found = differences(df, con, sqls[name])
                state = "ok  " if not found else "DIFF"
            else:
                found, state = [f"{df.count()} rows, no SQL"], "rows"
        except Exception as error:
            found, state = [f"{type(error).__name__}: {str(error)[:600]}"], "FAIL"
        print(state, name, f"{time.time() - start:.1f}s", *found, sep="\n       " if found else " ", flush=True)


if __name__ == "__main__":
    main()
