"""Exact dedup by two-pass Bloom filtering, in DataFrame functions alone.

Pass one hashes each normalised text and sets, for two cells of each hash, whether a cell was hit more than
once. Pass two tests each row: a text that occurs twice has hit both its cells twice, so rows whose cells were
not are unique and pass straight through; only the others shuffle. The filter has about 16 bits a row up to a
fixed bound; beyond the bound it only lets more rows through to the exact step, the result stays whole.

Defined cases: a null text counts as empty. A row with a null doc_id stays only in a group without any other.
Of rows that repeat both doc_id and text, any one stays, whatever their other columns. Texts may be of any length. An
empty table gives no rows. Other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import BitFilter, attach_groups, column, staged, table, whole_row

SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space made one space, as bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256."""
    keyed = staged(docs.select(column(id_col).alias("_id"), text_digest(column(text_col)).alias("_digest")).withColumn("_row", F.monotonically_increasing_id()), "digests")
    n_rows = keyed.count()
    marked = BitFilter(keyed.select(F.col("_digest").alias("key")), n_rows, twice=True).mark(keyed, F.col("_digest"))
    maybe = marked.filter("_maybe").drop("_maybe")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("first")
    groups = staged(maybe.groupBy("_digest").agg(first, F.count("*").alias("group_size")), "groups")
    out = [F.col("_id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("first.row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256")]
    repeated = attach_groups(maybe, groups, "_digest", "group_size", n_rows).select(*out)
    single = marked.filter("not _maybe").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
    return single.unionByName(repeated)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns. Rows that cannot repeat are not shuffled."""
    keyed = staged(docs.select(column(id_col).alias("_id"), text_digest(column(text_col)).alias("_digest")), "digests")
    n_rows = keyed.count()
    seen = BitFilter(keyed.select(F.col("_digest").alias("key")), n_rows, twice=True)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias("_first")
    groups = staged(seen.mark(keyed, F.col("_digest")).filter("_maybe").groupBy("_digest").agg(first, F.count("*").alias("_size")), "groups")
    whole = docs.select(whole_row(docs).alias("_row"), column(id_col).alias("_id"), text_digest(column(text_col)).alias("_digest"))
    marked = seen.mark(whole, F.col("_digest"))
    single = marked.filter("not _maybe").select("_row.*")
    # Only a group's own first row goes on, so dropping repeats of it moves few rows.
    maybe = marked.filter("_maybe").drop("_maybe")
    kept = attach_groups(maybe, groups, "_digest", "_size", n_rows).filter(F.col("_id").eqNullSafe(F.col("_first.id")))
    return single.unionByName(kept.dropDuplicates(["_digest"]).select("_row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
