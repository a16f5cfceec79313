"""python -m tests.run_compare [folder] [name prefix ...]: quick check outside pytest."""

import sys
import time

from pagesieve.session import local_session
from tests.compare import check, duck

if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, name, queries, oracles, folder, con)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'BAD ' if problem else 'ok  '} {name}{kind} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
