"""Run a registered query and its SQL over the same Parquet files and compare."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return value + 0.0 if math.isfinite(value) else str(value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return float(value)
    return value


def _family(kind: str) -> str:
    kind = kind.lower()
    if kind in {"int", "bigint", "integer", "smallint", "tinyint", "hugeint"}:
        return "int"
    if kind in {"double", "float"} or kind.startswith("decimal"):
        return "float"
    return {"string": "text", "varchar": "text"}.get(kind, kind)


def normal_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in rows]
    # floats last and coarsely, so that the last bit of one does not change the order of rows
    return sorted(rows, key=lambda r: (repr([x for x in r if not isinstance(x, float)]),
                                       [round(x, 7) for x in r if isinstance(x, float)]))


def mismatch(df, con, sql: str) -> str | None:
    """None when rows, names and type families agree, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = normal_rows(cursor.fetchall(), names)
    kinds = {r[0]: _family(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got_kinds = {name: _family(kind) for name, kind in df.dtypes}
    if got_kinds != kinds:
        return f"types {got_kinds} != {kinds}"
    got = normal_rows([tuple(r) for r in df.collect()], df.columns)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b and not all(_close(x, y) for x, y in zip(a, b)):
            return f"{a} != {b}"
    return None


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b
