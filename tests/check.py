"""Run registered queries and compare with their SQL in DuckDB: python tests/check.py [sf_dir] [names...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

import __spark_entry__ as entry
from cohortlens.session import get_spark

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    cols = sorted(got.columns)
    for c in cols:
        g, w = got[c], want[c]
        if (g.dtype.kind in "iub") != (w.dtype.kind in "iub") and not (g.isna().any() or w.isna().any()):
            return f"type of {c}: {g.dtype} != {w.dtype}"

    def norm(df):
        out = df[cols].copy()
        for c in cols:
            if out[c].dtype.kind in "iuf" or out[c].dtype == object and out[c].map(lambda v: isinstance(v, (int, float)) or v is None).all():
                out[c] = pd.to_numeric(out[c]).astype(float).round(9) + 0.0
            else:
                out[c] = out[c].astype(str).replace({"nan": "None", "<NA>": "None"})
        return out.sort_values(cols, kind="stable").reset_index(drop=True)

    a, b = norm(got), norm(want)
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{(~same).sum()} differ in {c}: {a[c][i]!r} != {b[c][i]!r} at {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("check", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf), entry.oracle_sql()
    names = sys.argv[2:]
    if names == ["sql"]:
        names = list(sql)
    elif names == ["nosql"]:
        names = [n for n in entry.queries() if n not in sql]
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        note = "rows only"
        if name in sql:
            try:
                note = differences(got, con.execute(sql[name]).fetchdf()) or "ok"
            except Exception as e:
                note = f"SQL {str(e)[:500]}"
        bad += note not in ("ok", "rows only")
        print(f"{'ok  ' if note in ('ok', 'rows only') else 'DIFF'} {name} {len(got)} rows {took:.1f}s {'' if note == 'ok' else note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
