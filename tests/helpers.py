"""Helpers that the test modules import (fixtures are in conftest.py)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows(df, *cols):
    """Collected rows as plain tuples, sorted, optionally projected."""
    if cols:
        df = df.select(*cols)
    return sorted((tuple(r) for r in df.collect()),
                  key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))
