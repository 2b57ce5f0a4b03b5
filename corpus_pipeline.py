"""A training corpus from raw documents: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents. A row is told by its doc_id and a hash of its text, so repeated
doc_ids don't mix up decisions; extra columns stay as they are.

Defined results: null texts count as empty; the rows of an empty table give an empty result at each stage. Of exact
copies the smallest doc_id stays, and one row of it; of a component of near copies the smallest (doc_id, text hash) stays;
texts without words have no near copies. Rows without a doc_id are judged by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import materialize, release, table
from loomgraph.llm.decontaminate import contaminated
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.ngram_join import ngram_components
from loomgraph.llm.packing import pack
from loomgraph.llm.quality import importance_resample


def text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def restricted(docs: DataFrame, chosen: DataFrame, key_of: Column) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, key) is among the chosen ones."""
    keyed = docs.withColumn("__key", key_of)
    chosen = chosen.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("__id"), F.col("key").alias("__chosen")).distinct()
    kept = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["__id"]) & (keyed["__key"] == chosen["__chosen"]), "left_semi")
    return kept.drop("__key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    drawn = importance_resample(docs, table(spark, sf_dir, "labels"))
    return restricted(docs, drawn.where("kept"), F.xxhash64(text()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text."""
    release(spark)
    found = exact_dedup(docs)
    chosen = found.where("kept").select("doc_id", F.col("text_sha256").alias("key"))
    kept = restricted(docs, chosen, F.sha2(text(), 256))
    return kept.withColumn("__sha", F.sha2(text(), 256)).dropDuplicates(["__sha"]).drop("__sha")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    release(spark)
    found = ngram_components(docs)
    named = found.where("n_shingles > 0 and component_id is not null")
    first = named.groupBy("component_id").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first"))
    chosen = first.select("first.doc_id", "first.key").unionByName(found.where("n_shingles = 0 or component_id is null").select("doc_id", "key"))
    return restricted(docs, chosen, F.xxhash64(text()))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("__id"), F.col("key").alias("__leak")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(text()))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["__key"] == found["__leak"]), "left_anti").drop("__key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("decontaminate", leaks),
    ("packing", packed),
]

#: The model, the similarity join and the packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
