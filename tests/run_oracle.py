"""python -m tests.run_oracle [sf] [name prefix …] — timings and mismatches."""

import sys
import time

from tests.conftest import make_session
from tests.oracle import compare, duck

import __spark_entry__ as entry

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
wanted = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = make_session()
con = duck(sf_dir)
queries, oracles = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in queries.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    t = time.time()
    try:
        if name in oracles:
            msg = compare(fn(spark, sf_dir), con, oracles[name])
        else:
            msg = f"rows only: {fn(spark, sf_dir).count()}"
    except Exception as e:  # report and go on
        msg = f"FAILED {type(e).__name__}: {str(e)[:600]}"
    took = time.time() - t
    ok = msg is None or msg.startswith("rows only")
    bad += not ok
    print(f"{'ok ' if ok else 'BAD'} {took:6.1f}s {name} {msg or ''}", flush=True)
print("bad:", bad)
