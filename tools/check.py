"""Compare registered queries with their SQL twins: ``python tools/check.py [sf] [name prefix ...]``.

``CHECK_NO_BROADCAST=1`` turns broadcasts off, so that every lookup shuffles.
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusweave.queries import registry  # noqa: E402
from corpusweave.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def canonical(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else f"{value:.9g}")
    return (3, type(value).__name__ + ":" + str(value))


def compare(spark_df, relation):
    cols = sorted(spark_df.columns)
    if cols != sorted(relation.columns):
        return f"columns {cols} != {sorted(relation.columns)}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    odd = [(f.name, f.dataType.simpleString(), types[f.name]) for f in spark_df.schema.fields
           if TYPES.get(f.dataType.simpleString()) != types[f.name]]
    if odd:
        return f"TYPES {odd}"
    left = sorted(tuple(canonical(r[c]) for c in cols) for r in spark_df.collect())
    order = [relation.columns.index(c) for c in cols]
    right = sorted(tuple(canonical(r[i]) for i in order) for r in relation.fetchall())
    if left == right:
        return f"ok {len(left)} rows" + (" EMPTY" if not left else "")
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    show = lambda rows: [dict(zip(cols, (v[1] for v in r))) for r in rows]
    return f"DIFF {len(left)} vs {len(right)} rows\n   spark {show(only_left)}\n   sql   {show(only_right)}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", 8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("CHECK_NO_BROADCAST"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, query in registry().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = query.build(spark, folder)
            if query.sql:
                result = compare(df, con.sql(query.sql))
            else:
                result = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            lines = [x for x in str(error).splitlines() if x.strip()]
            result = f"ERROR {type(error).__name__} " + " | ".join(lines[:6])[:900]
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:26s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
