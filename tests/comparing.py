"""Rows of both engines, in any order."""


def normal(v):
    """Values as both engines can be compared by."""
    return float(f"{v:.9g}") if isinstance(v, float) else v


def same_rows(df, relation):
    """Holds a DataFrame against a DuckDB relation, rows in any order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    order = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    mine = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=order)
    theirs = sorted((tuple(normal(r[i]) for i in at) for r in relation.fetchall()), key=order)
    assert mine == theirs
