"""Run registered queries and their SQL side by side and report every difference.

    python tests/oracle_check.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rentlens.catalog import load  # noqa: E402
from rentlens.catalog.fixtures import BASE_TABLES  # noqa: E402


def engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, every cell as text."""
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "∅"
        if isinstance(v, float):
            return repr(v + 0.0)
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return str(v)

    out = pd.DataFrame({c: [cell(v) for v in df[c].astype(object)] for c in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def kinds(table) -> dict[str, str]:
    import pyarrow as pa

    def kind(t: pa.DataType) -> str:
        if pa.types.is_integer(t):
            return str(t)
        return str(t).replace("large_", "").split("(")[0].split("[")[0]

    return {f.name: kind(f.type) for f in table.schema}


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float]:
    registry = load()
    start = time.time()
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    took = time.time() - start
    if name not in registry.ORACLES:
        return "rows only", got.num_rows, took
    want = con.execute(registry.ORACLES[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {got.column_names} / {want.column_names}", got.num_rows, took
    a, b = canonical(got.to_pandas()), canonical(want.to_pandas())
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}", got.num_rows, took
    wrong = a.ne(b).any(axis=1)
    if wrong.any():
        sample = pd.concat([a[wrong].head(4), b[wrong].head(4)], keys=["spark", "sql"])
        return f"{int(wrong.sum())} values differ\n{sample.to_string()}", got.num_rows, took
    ka, kb = kinds(got), kinds(want)
    odd = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c] and "null" not in (ka[c], kb[c])}
    return (f"types {odd}" if odd else "ok"), got.num_rows, took


def main() -> int:
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = make_session()
    con = engine(sf_dir)
    bad = 0
    for name in load().QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            result, rows, took = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            result, rows, took = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        bad += result not in ("ok", "rows only")
        print(f"{name:34s} {rows:8d} rows {took:6.2f}s  {result}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
