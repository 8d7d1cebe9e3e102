"""Run bound queries against their SQL counterparts: ``python check.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

from tablewright.plans import ORACLES, QUERIES
from tablewright.session import local_session
from tests.oracle import compare, connect

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                verdict = compare(df, con, ORACLES[name])
            else:
                verdict = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:900]}"
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - begin:.1f}s {verdict or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
