"""Compare registered queries with their SQL twins: columns, types, rows and values."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def same(a, b, tolerance: float) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(float(a) - float(b)) <= tolerance * max(1.0, abs(float(a)))
    return a == b


def differences(spark_df, con, sql: str, tolerance: float = 0.0) -> list[str]:
    """What differs; an empty list is a match."""
    names = sorted(spark_df.columns)
    relation = con.sql(sql)
    if names != sorted(relation.columns):
        return [f"columns {names} / {sorted(relation.columns)}"]
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), "?") for f in spark_df.schema}
    other = dict(zip(relation.columns, map(str, relation.types)))
    found = [f"{n}: {kinds[n]} / {other[n]}" for n in names if kinds[n] != other[n]]
    quoted = ", ".join(f'"{n}"' for n in names)
    left = [tuple(r[n] for n in names) for r in spark_df.collect()]
    right = relation.select(quoted).fetchall()
    if len(left) != len(right):
        return [*found, f"{len(left)} / {len(right)} rows"]
    if not left:
        return [*found, "no rows"]

    def order(row):
        return [(v is None, "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)) for v in row]

    for a, b in zip(sorted(left, key=order), sorted(right, key=order)):
        if not all(same(x, y, tolerance) for x, y in zip(a, b)):
            return [*found, f"{a} / {b}"]
    return found


def main(sf_dir: str, *only: str) -> int:
    from __spark_entry__ import oracle_sql, queries
    from clinigrid.session import local_session

    spark, con = local_session(), duck(sf_dir)
    wrong = 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        try:
            df = query(spark, sf_dir)
            sql = oracle_sql().get(name)
            if sql:
                found = differences(df, con, sql)
            else:
                found = [] if df.collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - a report over all queries
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        wrong += bool(found)
        mark = "DIFFERS" if found else ("ok" if sql else "rows")
        print(f"{mark:8}{name:32}{time.perf_counter() - started:6.2f}s", *found[:4], sep=" ", flush=True)
    return wrong


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main(*sys.argv[1:]))
