"""Quality by importance resampling of hashed n-gram models with Gumbel top-k.

A text becomes two sequences: its words and punctuation in lower case, and their shapes (lower, capital or upper-case
word, number, punctuation, repeated word). N-grams of one and two words and of one to three shapes are hashed into
buckets. Two multinomial models of each sequence are fitted: the target from rows labelled as good (at most
``sample_rows``, chosen by a hash of doc_id), the raw one from all documents. A text's weight is the mean log ratio of the
two over its n-grams. Documents are drawn without replacement by adding Gumbel noise to weight / temperature and taking
the k largest; k is the number of all documents whose weight reaches the level that parts the labelled rows best, or
``keep_share`` of all documents. The noise has a standard deviation of 1.28 * temperature in the weight's own unit, so the
default moves documents by 0.03 a word: it reorders documents near the level and leaves the others where they are.

Defined results: null and empty texts have weight 0, no n-gram speaks against them; without labels of both kinds all
documents are kept; rows whose drawn key ties with the k-th largest all stay, so rows that repeat a doc_id and text stay
or go together; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, slices, table, texts

SAMPLE_ROWS, TEMPERATURE, SEED = 20_000, 0.02, 11
#: Bits of the buckets of word n-grams, which come first, and of shape n-grams.
WORD_BITS, SHAPE_BITS = 14, 13
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
FIND = re.compile(r"\w+|[^\w\s]+").findall
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Words that a task remembers.
KNOWN = 100_000


def shape(token: str) -> int:
    """A small number for the token's shape; punctuation keeps its first and whether it repeats."""
    if token.isdigit():
        return 1
    if token[0].isalnum() or token[0] == "_":
        if not any(c.isalpha() for c in token):
            return 1
        if any(c.isdigit() for c in token):
            return 2
        if token.islower():
            return 3
        if token.isupper():
            return 4 if len(token) == 1 else 5
        return 6 if token[1:].islower() else 7
    return 16 + (ord(token[0]) % 100) * 2 + (len(token) > 1)


def hashed(codes: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """Buckets of all n-grams of one to ``longest`` codes."""
    with np.errstate(over="ignore"):
        grams = [codes * MIX[0]]
        for n in range(1, longest):
            if len(codes) > n:
                grams.append(grams[-1][:-1] * MIX[n] + codes[n:] * MIX[0])
        keys = np.concatenate(grams)
        keys ^= keys >> np.uint64(29)
        keys = (keys * MIX[1]) >> np.uint64(64 - bits)
    return keys.astype(np.int64)


class Grams:
    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.words, self.shapes = array("Q"), array("Q")

    def buckets(self, text: str) -> np.ndarray:
        """The bucket of each n-gram of the text."""
        tokens, index = FIND(text), self.index
        if not tokens:
            return np.empty(0, np.int64)
        if len(index) > KNOWN:
            self.clear()
            index = self.index
        for t in set(tokens).difference(index):
            index[t] = len(index)
            self.words.append(self.hash(t.lower()))
            self.shapes.append(shape(t) + 1)
        at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        words, shapes = np.frombuffer(self.words, np.uint64)[at], np.frombuffer(self.shapes, np.uint64)[at]
        again = np.flatnonzero((words[1:] == words[:-1]) & (shapes[1:] >= 4) & (shapes[1:] <= 8))
        shapes[again + 1] = 9
        return np.concatenate([hashed(words, 2, WORD_BITS), hashed(shapes, 3, SHAPE_BITS) + (1 << WORD_BITS)])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of each bucket over all rows; a task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 1 << 20):
            found = [grams.buckets(x) for x in batch.column(0).to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Smoothed logarithms of the buckets' shares, for words and for shapes apart."""
    return np.concatenate([np.log((c + 0.5) / (c.sum() + 0.5 * len(c))) for c in np.split(counts, [1 << WORD_BITS])])


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in slices(batches, 1 << 20):
            found = [float(ratio[b].mean()) if len(b := grams.buckets(x)) else 0.0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), batch.column(2)], names=["doc_id", "log_weight", "key"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "doc_id long, log_weight double, key long")


def best_level(weights: np.ndarray, good: np.ndarray) -> float:
    """The middle of the gap that parts good rows from others with the fewest errors."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    errors = np.concatenate([[0], np.cumsum(g)]) + (len(g) - g.sum()) - np.concatenate([[0], np.cumsum(1 - g)])
    at = int(np.flatnonzero(errors == errors.min())[0])  # good rows below, others above; the lower of equal levels keeps more
    if at == 0:
        return float(w[0]) - 1e-9
    return float((w[at - 1] + w[min(at, len(w) - 1)]) / 2)


def kth_largest(keys: DataFrame, k: int, key: str = "gumbel_key") -> float:
    """The k-th largest key, by counting in ever narrower bins."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = (high - low) / 1024
        bins = F.least(F.floor((F.col(key) - low) / width), F.lit(1023)).alias("bin")
        found = keys.where(F.col(key).between(low, high)).groupBy(bins).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):  # 1024 rows at most
            if r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, temperature: float = TEMPERATURE, keep_share: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, key (xxhash64 of the text), kept."""
    docs = texts(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
    sampled = materialize(docs.join(F.broadcast(sample), "doc_id").select(F.col("quality").cast("long").alias("doc_id"), "text"), "quality-sample")  # sample_rows keys at most
    kinds = {r["doc_id"] for r in sampled.select("doc_id").distinct().collect()}
    noise = -F.log(-F.log((F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2**52)) + 0.5) / float(2**52)))
    if kinds != {0, 1}:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.xxhash64("text").alias("key"), noise.alias("gumbel_key"), F.lit(True).alias("kept"))
    raw, target = bucket_counts(docs), bucket_counts(sampled.where("doc_id = 1"))
    ratio = np.clip(log_shares(target) - log_shares(raw), -4, 4)
    fitted = weigh(sampled, ratio).toPandas()
    level = best_level(fitted["log_weight"].to_numpy(), fitted["doc_id"].to_numpy().astype(float))
    keys = weigh(docs, ratio).withColumn("gumbel_key", F.col("log_weight") / temperature + noise)
    keys = materialize(keys, "quality-keys")
    total, good = keys.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= level)).first()
    k = good if keep_share is None else round(keep_share * total)
    if k >= total:
        return keys.withColumn("kept", F.lit(True))
    if k <= 0:
        return keys.withColumn("kept", F.lit(False))
    return keys.withColumn("kept", F.col("gumbel_key") >= kth_largest(keys, k))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
