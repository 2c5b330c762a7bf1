"""From raw documents to packed sequences: five stages, each over all that the one before has kept.

Documents that language identification rejects (no text, or no letter) go; of equal texts one stays; of documents
that are similar on five-word n-grams one of each component stays; words that an earlier document has in a passage
of 13 words are removed; what is left is packed into sequences of 4096 tokens. Counted as part of lucidgraph.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import staged, table, whole_row
from lucidgraph.llm.exact_dedup import exact_dedup
from lucidgraph.llm.jaccard_join import ngram_dedup
from lucidgraph.llm.language_id import fit_language_model, has_letter, predict_languages
from lucidgraph.llm.packing import pack_pieces, tokenized_pieces
from lucidgraph.llm.substring_dedup import substring_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that have a letter, with the language predicted as their lang where they had none.

    Null and empty texts go. Ties go to the first language by name; rows that repeat are judged one by one; an empty
    table stays empty; other columns are carried along. Where no language can be learned, lang stays as it is.
    """
    model = fit_language_model(docs)
    if model is None:
        return docs.filter(F.udf(has_letter, "boolean")("text"))
    rows = docs.select(whole_row(docs).alias("row"), F.col("text").alias("text"))
    found = predict_languages(rows, model).filter("lang_pred <> 'und'")
    return found.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest doc_id stays; null ids come last; rows that repeat count as copies."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays. Rows, not ids, are joined: a text that is like no other stays, whatever its id.
    Rows without id or words stay."""
    return ngram_dedup(docs, n=5, similar=(80, 100))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where words were removed. Documents of which nothing is left go; null ids stay whole."""
    kept = substring_dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece. Null texts are one piece of the end id; an empty table gives no rows."""
    import public_tokenizers

    return pack_pieces(tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs


#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
