"""List columns whose Spark type and SQL type differ in kind."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import check_queries  # noqa: E402

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def main():
    from annalis.catalog import ORACLES, QUERIES
    from annalis.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("types", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = check_queries.duck(sf)
    only = sys.argv[2] if len(sys.argv) > 2 else "."
    checked = 0
    for name, sql in ORACLES.items():
        if not re.search(only, name):
            continue
        checked += 1
        types = {d[0]: str(d[1]) for d in con.execute(sql).description}
        for c, t in QUERIES[name](spark, sf).dtypes:
            if KINDS.get(t) != types.get(c):
                print(f"{name}: {c} spark {t} sql {types.get(c)}", flush=True)
    print(f"{checked} queries checked")
    spark.stop()


if __name__ == "__main__":
    main()
