"""Spark-versus-DuckDB comparison used by the tests and by hand:

    python -m tests.oracle [sf_dir] [name ...]

Runs each registered query in Spark and its oracle SQL in DuckDB on the same
parquet tables and compares row count, column names, coarse column types and
an order-insensitive hash of the values.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t) -> str:
    """Exact Arrow type, except that string encodings form one family."""
    s = str(t).lower()
    if s in ("string", "large_string", "string_view"):
        return "string"
    return s


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 9))
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def table_digest(tbl) -> tuple[int, list[str], dict, str]:
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    rows = sorted("|".join(_norm(col[i]) for col in data) for i in range(tbl.num_rows))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    kinds = {c: _kind(tbl.schema.field(c).type) for c in cols}
    return tbl.num_rows, cols, kinds, h


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        rec = {"oracle": name in sqls}
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toArrow()
            rec["spark_s"] = round(time.time() - t0, 2)
            rec["rows"] = sp.num_rows
            if name in sqls:
                dd = con.sql(sqls[name]).to_arrow_table()
                n1, c1, k1, h1 = table_digest(sp)
                n2, c2, k2, h2 = table_digest(dd)
                rec.update(rows_ok=n1 == n2, cols_ok=c1 == c2, kinds_ok=k1 == k2, hash_ok=h1 == h2,
                           oracle_rows=n2)
                if not (c1 == c2 and k1 == k2):
                    rec["spark_cols"], rec["oracle_cols"] = k1, k2
        except Exception as exc:  # noqa: BLE001
            rec["error"] = f"{type(exc).__name__}: {str(exc)[:600]}"
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from quarry.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    res = compare(spark, sf, names)
    bad = [n for n, r in res.items() if r.get("error") or (r["oracle"] and not (
        r.get("rows_ok") and r.get("cols_ok") and r.get("hash_ok") and r.get("kinds_ok")))]
    print("FAILED:", bad)
    print(f"{len(res) - len(bad)}/{len(res)} ok")
