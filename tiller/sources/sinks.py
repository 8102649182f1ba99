"""Sinks: JSON documents (S5), CSV summaries (S6) and multi-section reports
(S7).  Writers are distributed; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

FORMATS = ("json", "csv", "parquet")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row (``to_json`` of nested structs works too)."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line.  Array/struct columns become JSON text."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def document(sections: Mapping[str, DataFrame]) -> DataFrame:
    """The nested document of a report as rows (section, json).

    Each row of a section is one JSON object; sections of any size stay
    distributed, and a reader groups them by name.
    """
    from pyspark.sql import functions as F

    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(
        *[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))
        for name, df in sections.items() if df is not None]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def write_document(sections: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write ``document(sections)`` as JSON lines, a folder for each section."""
    document(sections).write.mode(mode).partitionBy("section").json(path)


def write_sections(sections: Mapping[str, DataFrame | None], root: str,
                   fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """One directory per report section; absent sections are skipped.

    Returns the names of the sections written.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {FORMATS}")
    written = []
    for name, df in sections.items():
        if df is None:
            continue
        path = f"{root.rstrip('/')}/{name}"
        if fmt == "json":
            write_json(df, path, mode)
        elif fmt == "csv":
            write_csv(df, path, mode)
        else:
            df.write.mode(mode).parquet(path)
        written.append(name)
    return written
