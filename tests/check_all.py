"""Run every registered query (or those whose names start with an argument) against its SQL."""

import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, ".")
from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from loomgraph.runtime import build_session  # noqa: E402


def main() -> None:
    path = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    words = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()

    def run(name: str) -> bool:
        start = time.time()
        try:
            df = qs[name](spark, path)
            msg = compare(df, connect(path), sqls[name]) if name in sqls else (None if df.count() > 0 else "no rows")
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        if msg or words:
            print("FAIL" if msg else "ok  ", name, f"{took:.1f}s", msg or ("" if name in sqls else "(no sql)"), flush=True)
        return bool(msg)

    names = [n for n in sorted(qs) if not words or any(n.startswith(w) for w in words)]
    with ThreadPoolExecutor(4) as pool:
        bad = sum(pool.map(run, names))
    print("failures:", bad, "of", len(names), "queries; registered:", len(qs), "with sql:", len(sqls))


if __name__ == "__main__":
    main()
