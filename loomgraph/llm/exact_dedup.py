"""Exact dedup with a log-structured merge index of text digests (DataFrame functions only).

* memtable: while a task reads its split, the map side of the aggregation holds one entry for each digest it has seen,
  with the identifier to keep and a count, so a hot text leaves a task once;
* flush: the tasks are dealt to ``runs`` runs; each run is written sorted by digest, with a Parquet bloom filter on it;
* compaction: the runs are merged into one sorted run, keeping the smallest (or largest) identifier and summing counts;
* filter: the digests that the compacted run holds more than once set bits of a filter of a fixed size. Each row probes
  the filter by its digest; a row that misses stands alone for certain and is answered on the spot;
* byte verification: the texts of rows that hit are compared by digest. Where a digest turns out to stand for different
  texts, its rows are grouped by the texts themselves.

The filter is one broadcast value of ``FILTER_BLOCKS`` * 4 KB at most, whatever the input. When the corpus has more
repeated digests than it tells apart, more rows take the way through the index; the answer stays the same.

Defined results: a null text counts as empty; empty texts equal each other; a null identifier is a row like any
other and is never kept before a real one; repeated rows count each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table, texts

#: Filters of the runs, each of the smallest of twelve sizes that holds its run's digests, as a run may have few.
BLOOM = {"parquet__bloom__filter__enabled#digest": "true", "parquet__bloom__filter__adaptive__enabled": "true", "parquet__bloom__filter__candidates__number": "12"}
RUNS = 4
#: Blocks of 32,768 bits, and the bits that a digest sets.
FILTER_BLOCKS, FILTER_HASHES = 256, 2
#: Parts that a repeated digest's rows are spread over when they look it up.
SALTS = 8


def digest_of(text: Column, digest_bits: int = 256) -> Column:
    """The first ``digest_bits`` (a multiple of 4) of SHA-256, in hex. Fewer bits serve to test collisions."""
    return F.sha2(text, 256) if digest_bits == 256 else F.substring(F.sha2(text, 256), 1, digest_bits // 4)


def chosen(keep: str, column: str) -> Column:
    return {"smallest": F.min, "largest": F.max}[keep](column)


def build_index(rows: DataFrame, keep: str = "smallest", runs: int = RUNS) -> DataFrame:
    """Sorted runs (run, digest, keep_id, group_size) of (doc_id, digest), written to the shared folder."""
    entries = rows.select("doc_id", "digest", F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
    entries = entries.groupBy("run", "digest").agg(chosen(keep, "doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialize(entries.sortWithinPartitions("run", "digest"), "digest-runs", **BLOOM)


def compact(*indexes: DataFrame, keep: str = "smallest") -> DataFrame:
    """One sorted run (digest, keep_id, group_size) of the runs of one or several builds."""
    merged = indexes[0]
    for more in indexes[1:]:
        merged = merged.unionByName(more)
    merged = merged.groupBy("digest").agg(chosen(keep, "keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return materialize(merged.sortWithinPartitions("digest"), "digest-compacted", **BLOOM)


def slots(digest: Column) -> list[Column]:
    """The filter's bits that a digest sets."""
    return [F.pmod(F.xxhash64(F.lit(i), digest), F.lit(FILTER_BLOCKS * 32_768)) for i in range(FILTER_HASHES)]


def filter_of(repeated: DataFrame) -> Column:
    """The filter of the digests, an array of ``FILTER_BLOCKS`` bitmaps, as a scalar subquery."""
    bits = repeated.select(F.explode(F.array(*slots(F.col("digest")))).alias("slot"))
    filled = bits.groupBy((F.col("slot") / 32_768).cast("long").alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % 32_768).alias("bits"))
    every = repeated.sparkSession.range(FILTER_BLOCKS).join(filled, F.col("id") == F.col("block"), "left").select("id", F.coalesce("bits", F.lit(b"")).alias("bits"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda b: b["bits"])
    return every.agg(blocks.alias("blocks")).scalar()


def may_repeat(filled: Column, digest: Column) -> Column:
    """Whether all bits of a digest are set."""

    def is_set(slot: Column) -> Column:
        block = F.element_at(filled, (slot / 32_768).cast("int") + 1)
        byte = F.conv(F.hex(F.substring(block, ((slot % 32_768) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (slot % 8).cast("int")) == 1, F.lit(False))  # an empty block has no bits

    first, *others = map(is_set, slots(digest))
    for other in others:
        first = first & other
    return first


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest_bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` has doc_id and text. Of equal texts the ``keep`` ("smallest" or "largest") doc_id stays. If that
    doc_id repeats within the group, each of its rows is marked as kept, as rows have no other identity.
    """
    docs = texts(docs).withColumn("digest", digest_of(F.col("text"), digest_bits))
    sha = F.col("digest") if digest_bits == 256 else F.sha2("text", 256)
    rows = materialize(docs.select("doc_id", "digest", sha.alias("text_sha256")), "digests")
    repeated = compact(build_index(rows, keep), keep=keep).where("group_size > 1")
    hit = may_repeat(filter_of(repeated), F.col("digest"))
    # The bytes of hits: a digest stands for one text exactly if its smallest and its largest text are the same.
    # A task sends one row for each digest, so a hot text isn't gathered; lone digests that pass have one text anyway.
    mixed = docs.where(hit).groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("digest")
    mixed = materialize(mixed, "digest-collisions")
    spread = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int").alias("salt")
    looked_up = rows.where(hit).select("doc_id", "digest", salted, "text_sha256").join(spread, ["digest", "salt"], "left")
    alone = rows.where(~hit).select("doc_id", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), "text_sha256")
    found = alone.unionByName(looked_up.drop("salt"))
    if not mixed.isEmpty():
        collided = docs.where(hit).join(mixed, "digest", "left_semi").select("doc_id", "text")
        classes = collided.groupBy("text").agg(chosen(keep, "doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_text = collided.join(classes, "text").select("doc_id", F.lit("").alias("digest"), "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
        found = found.join(mixed, "digest", "left_anti").unionByName(by_text)
    lone = F.col("group_size").isNull()
    found = found.select("doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
