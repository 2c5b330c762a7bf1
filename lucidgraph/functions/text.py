"""Text measures and slices with 1-based positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def last_line_length(text: Column) -> Column:
    return F.length(F.element_at(F.split(text, "\n"), -1))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no from 1, line."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("_at", "line")).select(id_col, (F.col("_at") + 1).alias("line_no"), "line")


def source_slice(text: Column, start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """Text from 1-based start to inclusive end."""
    lines = F.slice(F.split(text, "\n"), start_line, end_line - start_line + 1)
    joined = F.array_join(lines, "\n")
    after = F.length(F.element_at(lines, -1)) - end_column
    return F.substr(joined, start_column, F.length(joined) - start_column + 1 - F.greatest(after, F.lit(0)))


def signature(name: Column, parameters: Column, return_type: Column, kind: Column) -> Column:
    """name(p: T, ...): R with the usual words where a type is unknown."""
    shown = F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type"], F.lit("any")))), ", ")
    head = F.when(kind == "constructor", F.lit("constructor")).otherwise(name)
    return F.concat(head, F.lit("("), F.coalesce(shown, F.lit("")), F.lit(")"), F.when(kind == "constructor", F.lit("")).otherwise(F.concat(F.lit(": "), F.coalesce(return_type, F.lit("unknown")))))
