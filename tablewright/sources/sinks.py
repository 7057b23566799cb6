"""Writing results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame

SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json"}


def format_of(path: str) -> str:
    """Format by suffix; unknown suffixes are CSV."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return SUFFIXES.get("." + name.rsplit(".", 1)[-1].lower() if "." in name else "", "csv")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write as CSV, TSV, parquet or JSON lines, by the suffix of the path; returns the format."""
    fmt = format_of(path)
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        (writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("extension", fmt)
         .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path))
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)
    return fmt


def auto_name(schema_name: str, when: datetime | None = None) -> str:
    """``<schema>_<timestamp>.csv``; the schema name keeps letters, digits, blanks, hyphens, underscores."""
    kept = "".join(ch for ch in schema_name if ch.isalnum() or ch in " -_").strip().replace(" ", "_")
    return f"{kept}_{(when or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}.csv"


def write_named(df: DataFrame, folder: str, schema_name: str) -> str:
    """Write under an automatic name; returns the path."""
    path = f"{folder.rstrip('/')}/{auto_name(schema_name)}"
    write_table(df, path)
    return path
