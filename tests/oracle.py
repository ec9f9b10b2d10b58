"""Compare registered queries with their SQL: ``python -m tests.oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if v is not None and v.__class__.__name__ == "Decimal":
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(names)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None if both agree, else what differs."""
    df = fn(spark, sf_dir)
    got, got_names = _canonical(df.collect(), df.columns)
    rel = con.sql(sql)
    want, want_names = _canonical(rel.fetchall(), rel.columns)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {sorted(set(got) - set(want))[:2]} {sorted(set(want) - set(got))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    types = {n: t for n, t in df.dtypes}
    for n, t in zip(rel.columns, map(str, rel.types)):
        pair = {"string": ["VARCHAR"], "bigint": ["BIGINT"], "int": ["INTEGER"], "double": ["DOUBLE"], "boolean": ["BOOLEAN"],
                "timestamp_ntz": ["TIMESTAMP", "TIMESTAMP_NS"]}.get(types[n])
        if pair is None or t not in pair:
            return f"type of {n}: {types[n]} != {t}"
    return None


def main(args: list[str]) -> int:
    from creatorlake.catalog import ORACLES, QUERIES
    from creatorlake.session import build_session

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = build_session("oracle", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) if name in ORACLES else (
                f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows")
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        if problem and not problem.startswith("no SQL"):
            bad += 1
        print(f"{'ok  ' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
