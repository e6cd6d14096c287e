"""Run registered queries against their SQL: ``python -m tests.run_queries [sf] [names…]``."""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as entry
from graticule.session import local_session
from tests.compare import connect, difference


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0.") else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            note = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            note = "ERROR " + (str(error)[:700] or traceback.format_exc()[-700:])
        bad = note is not None and not note.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.2f}s {note or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
