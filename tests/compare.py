"""Run registered queries beside their SQL twins: `python tests/compare.py [sf_dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


_KINDS = {"bigint": "int", "integer": "int", "int": "int", "smallint": "int", "tinyint": "int", "hugeint": "huge",
          "varchar": "text", "string": "text", "double": "double", "float": "float", "boolean": "boolean", "date": "date"}


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    kinds = {n: _KINDS.get(str(t).lower().split("(")[0], str(t).lower()) for n, t in ((c[0], c[1]) for c in cursor.description)}
    mine = {f.name: _KINDS.get(f.dataType.simpleString().split("(")[0], f.dataType.simpleString()) for f in df.schema.fields}
    found += [f"type of {n}: {mine[n]} / {kinds[n]}" for n in names if mine[n] != kinds[n] and len(theirs)]
    a, b = normal(ours, df.columns), normal(theirs, names)
    if len(a) != len(b):
        found.append(f"rows {len(a)} / {len(b)}")
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        missing = [x for x in b if x not in set(a)][:2]
        found.append(f"values: only ours {extra} only theirs {missing}")
    return found


def main() -> int:
    from millrace.session import build_session
    from __spark_entry__ import everything

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con, whole, bad = duck(sf_dir), everything(), 0
    for name, query in whole.queries.items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if name in whole.oracles:
                found = differences(query(spark, sf_dir), con, whole.oracles[name])
            else:
                found = [] if query(spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - start:.1f}s {'' if name in whole.oracles else '(rows only)'}", *found, flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
