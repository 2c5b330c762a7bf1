"""Facts that outlive a session: tables by file, a manifest of content hashes, and where they are kept."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph import schema
from lucidgraph.operators import maintenance
from lucidgraph.operators.recursion import written
from lucidgraph.sources import files

#: Manifests of another version are passed over.
VERSION = 1
_OFF = ("", "off", "none", "false", "0")
MANIFEST = "path STRING, content_hash STRING, git_blob_hash STRING"


def cache_dir(project_path: str, variable: str = "LUCIDGRAPH_CACHE_DIR") -> str | None:
    """The folder named by the variable; None where that says off; else one below the home folder, told by the project's
    name and a hash of its path."""
    said = os.environ.get(variable)
    if said is not None:
        return None if said.strip().lower() in _OFF else os.path.abspath(said.strip())
    return os.path.join(os.path.expanduser("~"), ".lucidgraph", "cache", slug(project_path))


def slug(project_path: str) -> str:
    whole = os.path.abspath(project_path)
    name = re.sub("[^a-z0-9]+", "-", os.path.basename(whole).lower()).strip("-")
    mark = hashlib.sha256(whole.encode()).hexdigest()[:8]
    return f"{name}-{mark}" if name else mark


class FactStore:
    """A folder on any file system that Spark reaches. Each save is a new version, which counts once its manifest names
    it; so a save that fails leaves the last one whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _head(self) -> dict | None:
        """What manifest.json says; None where there is none, or it can't be read, or its version is another."""
        path, fs = self._path("manifest.json")
        if not fs.exists(path):
            return None
        try:
            said = json.loads("\n".join(r[0] for r in self.spark.read.text(path.toString()).collect()))
        except ValueError:
            return None
        return said if isinstance(said, dict) and said.get("schema_version") == VERSION and isinstance(said.get("at"), str) else None

    def manifest(self) -> DataFrame:
        """path, content_hash, git_blob_hash of the files whose facts are kept; no rows where nothing is."""
        head = self._head()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/{head['at']}/manifest") if head else self.spark.createDataFrame([], MANIFEST)

    def tree_hash(self) -> str | None:
        return (self._head() or {}).get("git_tree_hash")

    def facts(self) -> dict[str, DataFrame]:
        head = self._head()
        if head is None:
            return {k: self.spark.createDataFrame([], ddl) for k, ddl in schema.FACT_TABLES.items()}
        return files.load_facts(self.spark, f"{self.folder}/{head['at']}")

    def save(self, sources: DataFrame, facts: dict[str, DataFrame], *, git_tree_hash: str | None = None, blobs: DataFrame | None = None) -> None:
        """sources: path, content, content_hash; files without content aren't kept. blobs: path, sha, from git."""
        kept = sources.filter("content <> ''").select("path", "content_hash")
        kept = kept.join(blobs.select("path", F.col("sha").alias("git_blob_hash")), "path", "left") if blobs is not None else kept.withColumn("git_blob_hash", F.lit(None).cast("string"))
        at, before = f"facts-{uuid.uuid4().hex}", self._head()
        files.write_facts({k: facts[k] for k in schema.FACT_TABLES}, f"{self.folder}/{at}")
        kept.write.parquet(f"{self.folder}/{at}/manifest")
        path, fs = self._path("manifest.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"schema_version": VERSION, "at": at} | ({"git_tree_hash": git_tree_hash} if git_tree_hash else {})).encode()))
        out.close()
        if before:
            old, fs = self._path(before["at"])
            fs.delete(old, True)

    def clear(self) -> None:
        path, fs = self._path("")
        fs.delete(path, True)

    def restore(self, sources: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        """Facts of the sources, those of unchanged files from the store, others extracted; and path, state of each file."""
        state = written(maintenance.cache_state(sources, self.manifest()))
        hits = state.filter("state = 'hit'").select(F.col("path").alias("file_path"))
        fresh = files.extract_facts(written(sources.join(state.filter("state in ('new', 'stale')"), "path", "left_semi")))
        kept = self.facts()
        facts = {k: written(kept[k].join(hits, "file_path", "left_semi").unionByName(fresh[k], allowMissingColumns=True)) for k in schema.FACT_TABLES}
        return facts | {"skipped": fresh["skipped"]}, state
