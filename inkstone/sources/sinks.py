"""Writers: JSON lines, parquet tables, reports, Markdown and the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators.graph import duplicate_keys


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Each row of a report as one JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_graph(nodes: dict[str, tuple[DataFrame, list[str]]], edges: DataFrame, path: str) -> None:
    """Node tables by label and the edge table, replacing what was there. A key that is not unique is an error."""
    for label, (df, keys) in nodes.items():
        if not duplicate_keys(df, keys).isEmpty():
            raise ValueError(f"{label}: {', '.join(keys)} is not unique")
    for label, (df, _) in nodes.items():
        write_table(df, f"{path}/nodes/{label}")
    write_table(edges, f"{path}/edges", "kind")


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
