"""Run all registered queries against DuckDB: ``python -m tests.run_oracle [sf] [prefix ...]``."""

import sys
import time

from loopweave.catalog import ORACLES, QUERIES
from loopweave.session import local_session
from tests.oracle import compare, connect


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if not name.startswith(prefixes):
            continue
        begin = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                outcome = compare(df, con, ORACLES[name]) or f"ok {con.sql(ORACLES[name]).shape}"
            else:
                outcome = f"rows {df.toArrow().num_rows}"
        except Exception as error:
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not outcome.startswith(("ok", "rows"))
        print(f"{name:42s} {time.time() - begin:6.2f}s  {outcome}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
