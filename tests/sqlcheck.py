"""Compare a query with its check SQL: columns, row count and values, in any row order."""

import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def check_db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        assert not math.isnan(v), "NaN in a result"
        return float(f"{v:.6f}") + 0.0
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def kind(t):
    t = t.lower()
    for name, keys in {"int": ("int",), "double": ("double", "float"), "text": ("varchar", "string"),
                       "bool": ("bool",), "time": ("timestamp",), "date": ("date",)}.items():
        if any(k in t for k in keys):
            return name
    return t


def compare(df, con, sql):
    """Raises with the first difference."""
    rows = df.collect()
    con.execute(sql)
    want_cols = [d[0] for d in con.description]
    want_types = [kind(str(d[1])) for d in con.description]
    got_cols, got = table_of(df.columns, rows)
    exp_cols, exp = table_of(want_cols, con.fetchall())
    assert got_cols == exp_cols, f"columns {got_cols} != {exp_cols}"
    got_types = {c: kind(t) for c, t in df.dtypes}
    for c, t in zip(want_cols, want_types):
        assert got_types[c] == t, f"type of {c}: {got_types[c]} != {t}"
    assert len(got) == len(exp), f"rows {len(got)} != {len(exp)}"
    for g, e in zip(got, exp):
        assert g == e or all(
            a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1.5e-6) for a, b in zip(g, e)
        ), f"{got_cols}\n{g}\n{e}"
    exact = all(g == e for g, e in zip(got, exp))
    return len(got), exact
