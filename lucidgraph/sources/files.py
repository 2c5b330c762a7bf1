"""Source files, usage logs and other inputs as DataFrames."""

from __future__ import annotations

import json
import traceback
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph import schema
from lucidgraph.functions import paths, text
from lucidgraph.operators.recursion import written


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, relative to root, of every file below it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.select(F.regexp_replace("path", f"^(file:)?/*{root.strip('/')}/", "").alias("path"))


def read_sources(spark: SparkSession, root: str, *, files: list[str] | None = None, folders: list[str] | None = None, gitignore: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """Supported files below root that no rule ignores: path, language, content, content_hash, n_lines, end_col, is_test.

    files and folders limit what is read, keep is a further condition on path; all of them come before parsing.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(paths.SUPPORTED_EXTENSIONS) + "}")
    out = raw.select(F.regexp_replace(F.col("_metadata.file_path"), f"^(file:)?/*{root.strip('/')}/", "").alias("path"), F.col("value").alias("content"))
    patterns = F.array(*map(F.lit, gitignore)) if gitignore else None
    wanted = paths.is_supported_file(F.col("path")) & ~paths.should_ignore_path(F.col("path"), patterns)
    if files or folders:
        wanted &= paths.any_of([F.col("path").isin(*(files or [""]))] + [F.col("path").startswith(f.rstrip("/") + "/") for f in folders or []])
    if keep is not None:
        wanted &= keep
    return with_header(out.filter(wanted))


def with_header(files: DataFrame) -> DataFrame:
    """files: path, content."""
    language = paths.detect_language(F.col("path"))
    return files.select("path", language.alias("language"), "content", text.content_hash(F.col("content")).alias("content_hash"), text.n_lines(F.col("content")).alias("n_lines"), text.last_line_length(F.col("content")).alias("end_col"), paths.is_test_file(F.col("path"), language).alias("is_test"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def parse_gitignore(spark: SparkSession, path: str) -> list[str]:
    """Its patterns; none where there is no file."""
    if not _exists(spark, path):
        return []
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    return [r[0] for r in lines.collect()]  # one short file


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines; no rows where there is no file."""
    return spark.read.schema(ddl).json(path) if _exists(spark, path) else spark.createDataFrame([], ddl)


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/sessions.jsonl", schema.SESSION)


def read_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/tool_calls.jsonl", schema.TOOL_CALL)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from lucidgraph.sources.python_frontend import extract

    for b in batches:
        out = []
        for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
            if language != "python":
                out.append((path, "skipped", json.dumps({"path": path, "reason": f"no front end for {language}"})))
                continue
            try:
                for table, rows in extract(path, content or "").items():
                    out += [(path, table, json.dumps(r)) for r in rows]
            except (SyntaxError, ValueError, RecursionError):
                out.append((path, "skipped", json.dumps({"path": path, "reason": traceback.format_exc(limit=0).strip()})))
        yield pd.DataFrame(out, columns=["path", "table", "row"])


def extract_facts(sources: DataFrame) -> dict[str, DataFrame]:
    """Fact tables of the files, parsed once; 'skipped' names files that can't be parsed. Other languages' facts come by read_facts."""
    rows = written(sources.select("path", "language", "content").mapInPandas(_extract, "path string, table string, row string"))
    kinds = schema.FACT_TABLES | {"skipped": "path STRING, reason STRING"}
    return {name: rows.filter(F.col("table") == name).select(F.from_json("row", ddl).alias("r")).select("r.*") for name, ddl in kinds.items()}


def read_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Fact tables from JSON documents, one a file: {"scope": [...], "definition": [...], ...}."""
    fields = ", ".join(f"{name} ARRAY<STRUCT<{_struct(ddl)}>>" for name, ddl in schema.FACT_TABLES.items())
    docs = spark.read.schema(fields).json(path, multiLine=True)
    return {name: docs.select(F.explode(name).alias("r")).select("r.*") for name in schema.FACT_TABLES}


def _struct(ddl: str) -> str:
    depth, out = 0, []
    for part in ddl.split(", "):
        out.append(part.replace(" ", ": ", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def write_facts(facts: dict[str, DataFrame], folder: str) -> None:
    for name, df in facts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in schema.FACT_TABLES.items()}
