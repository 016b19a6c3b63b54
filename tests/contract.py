"""Compare every registered query with its SQL oracle: python -m tests.contract SF_DIR [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(
        (tuple(int(v) if isinstance(v, bool) is False and isinstance(v, (int,)) else v for v in row)
         for row in plain.itertuples(index=False, name=None)),
        key=repr,
    )


def differences(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when columns and rows (as a multiset) are the same."""
    got = run(spark, sf_dir)
    mine = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    theirs = pd.DataFrame(answer.fetchall(), columns=names, dtype=object)
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    a, b = _rows(mine), _rows(theirs)
    if a == b:
        return None
    extra, missing = set(a) - set(b), set(b) - set(a)
    return (f"rows {len(a)} != {len(b)}; only in Spark {sorted(extra, key=repr)[:3]}; "
            f"only in SQL {sorted(missing, key=repr)[:3]}")


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from ripplemap.session import local_session

    sf_dir, wanted = argv[0], set(argv[1:])
    spark, con, bad = local_session(), duck(sf_dir), 0
    oracles = contract.oracle_sql()
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        if name not in oracles:
            print("NO ORACLE", name, flush=True)
            continue
        start = time.time()
        try:
            problem = differences(spark, con, run, oracles[name], sf_dir)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print("ok  " if problem is None else "BAD ", name, round(time.time() - start, 2),
              problem or "", flush=True)
    print("bad:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
