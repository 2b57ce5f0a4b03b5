"""Toxicity by compression distance.

Two zstandard dictionaries are made of the labelled rows that are not held out: one of all words of the toxic sample, one
of all words of the ordinary sample. Each word is written as a fixed code so that only whole words match, or as the
code of one of its stems where that tells the samples apart better; a dictionary holds the longer a part of a code the
more texts of its sample have the word, so a match saves bytes by how common the word is there. A text is cut into
windows of words; a window that compresses shorter under the toxic dictionary than under the ordinary one is close to the
toxic texts. The largest and the summed difference of a text give its score through a logistic calibration with the
label's share in all training labels. For the calibration, each half of the training rows is compared with dictionaries
of the other half, as a text's own words would favour its own label.

Training uses at most ``sample_rows`` labelled rows of each label, chosen by a hash of doc_id (a documented bound);
labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have no windows and get the score of a text without matches; without labels of
both kinds every score is the label's share (0 where there is no label at all); repeated rows get equal scores; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table, texts

SAMPLE_ROWS, WINDOW_WORDS, SEED = 4000, 16, 7
#: Lengths of the stems that may stand for all words that begin so.
STEMS = (4, 5, 6)
#: Bytes a word is written as, and bytes a dictionary holds of a word of no text: about the shortest match there is.
CODE, LEAST = 24, 6
FIND = re.compile(r"\w+").findall


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    #: All words and stems of both samples, with how far they tell the samples apart.
    units: dict[str, float] | None = None
    prior: float = 0.0
    weights: tuple[float, ...] | None = None
    window_words: int = WINDOW_WORDS


def code(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=CODE).digest()


#: Ends each window and both dictionaries, so that a block is never stored as it is and single matches count.
END = code("\0end") + code("\0end of a window")


def dictionary(words: list[str], codes: list[bytes], counts: np.ndarray, n_texts: int) -> bytes:
    """All words with a count, the most frequent last; the logarithm of the count decides how much of a code is held."""
    held = np.minimum(CODE, np.rint(LEAST + (CODE - LEAST) * np.log2(1.0 + counts) / np.log2(1.0 + max(1, n_texts)))).astype(int)
    return b"".join(codes[i][: held[i]] for i in sorted(np.flatnonzero(counts), key=lambda i: (counts[i], words[i]))) + END


class Distance:
    """Differences of window lengths under the two dictionaries."""

    def __init__(self, model: Model):
        import zstandard as zs

        self.size, self.units, self.known = model.window_words, model.units or {}, {}

        def compressor(content: bytes):
            log = max(17, len(content).bit_length() + 1)  # tables with room for every place of the dictionary
            params = zs.ZstdCompressionParameters.from_level(3, window_log=max(19, len(content).bit_length()), hash_log=log, chain_log=log, write_content_size=False, write_checksum=False, write_dict_id=False)
            own = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=params)
            return zs.ZstdCompressor(compression_params=params, dict_data=own).compress

        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)

    def code(self, word: str) -> bytes:
        """The code of the word or of a stem of it: of those that a sample has, the one that tells the samples apart best."""
        there = [u for u in (word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)) if u in self.units]
        return code(max(there, key=self.units.__getitem__, default=word))

    def features(self, text: str) -> tuple[float, float]:
        """The largest and the summed positive difference in bytes over all windows of the text."""
        words, known = FIND(text.lower()), self.known
        try:
            codes = b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.code(w)
            codes = b"".join([known[w] for w in words])
        step = self.size * CODE
        most = total = 0
        for at in range(0, len(codes), step):
            window = codes[at : at + step] + END
            if (d := len(self.ordinary(window)) - len(self.toxic(window))) > 0:
                most, total = max(most, d), total + d
        return float(most), float(total)


def inputs(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(most), np.minimum(most, 24) / 8, np.log1p(total)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's steps."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * b
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def apart(toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """How many standard errors the shares of toxic and of ordinary texts that have a word differ by."""
    a, b = (toxic + 0.5) / (n_toxic + 1), (ordinary + 0.5) / (n_ordinary + 1)
    return np.abs(a - b) / np.sqrt(a * (1 - a) / (n_toxic + 1) + b * (1 - b) / (n_ordinary + 1))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def parts_of(words: set[str]) -> set[str]:
    """Words as they are, and their stems, written with a closing *."""
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, window_words: int = WINDOW_WORDS) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    model = Model(prior=prior, window_words=window_words)
    if not counts.get(0) or not counts.get(1):
        return model
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(sample_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample_rows))
    sampled = materialize(docs.join(F.broadcast(sample), "doc_id").select("toxic", "text", F.xxhash64("text").alias("key"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "toxicity-sample")  # 2 * sample_rows keys at most

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text, key, half in zip(*(c.to_pylist() for c in batch.columns)):
                found = sorted(parts_of(set(FIND(text.lower()))))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * n, pa.int32()), pa.array([key] * n, pa.int64()), pa.array([half] * n, pa.int32()), pa.array(found, pa.string())], names=["toxic", "key", "half", "word"])

    groups = [(t, h) for t in (1, 0) for h in (0, 1)]
    sizes = {(r["toxic"], r["half"]): r["n"] for r in sampled.groupBy("toxic", "half").agg(F.count_distinct("key").alias("n")).collect()}
    if len({t for t, _ in sizes}) < 2:
        return model
    distinct = sampled.dropDuplicates(["toxic", "key"])  # copies of a text count once
    counted = [F.count(F.when((F.col("toxic") == t) & (F.col("half") == h), 1)).alias(f"n{t}{h}") for t, h in groups]
    seen = distinct.mapInArrow(words, "toxic int, key long, half int, word string").groupBy("word").agg(*counted).toArrow()  # the words of 2 * sample_rows texts at most
    names = seen["word"].to_pylist()
    codes, having = [code(w) for w in names], {(t, h): seen[f"n{t}{h}"].to_numpy() for t, h in groups}

    def trained(*halves: int) -> Model:
        (toxic, n_toxic), (ordinary, n_ordinary) = [(sum(having[t, h] for h in halves), sum(sizes.get((t, h), 0) for h in halves)) for t in (1, 0)]
        weights = apart(toxic, ordinary, n_toxic, n_ordinary)
        units = {names[i]: float(weights[i]) for i in np.flatnonzero(toxic + ordinary)}
        return Model(dictionary(names, codes, toxic, n_toxic), dictionary(names, codes, ordinary, n_ordinary), units, prior, window_words=window_words)

    model = trained(0, 1)
    parts = [featured(sampled.where(F.col("half") == h).select(F.col("toxic").cast("long").alias("doc_id"), "text"), trained(1 - h)) for h in (0, 1)]
    rows = parts[0].unionByName(parts[1]).toPandas()  # 2 * sample_rows at most
    if rows.empty:
        return model
    y = rows["doc_id"].to_numpy().astype(float)
    share = y.mean()
    w = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    model.weights = tuple(float(v) for v in logistic(inputs(rows["most"].to_numpy(), rows["total"].to_numpy()), y, w))
    return model


def featured(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model)
        for batch in batches:
            found = [distance.features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "most", "total"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, most double, total double")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, max_gain, sum_gain."""
    docs = texts(docs)
    model = fit(docs, labels, sample_rows, window_words)
    rows = featured(docs, model)
    if model.weights:
        a, b, c = model.weights
        z = F.lit(a) + F.least(F.col("most"), F.lit(24.0)) / 8 * b + F.log1p("total") * c
        score = 1 / (1 + F.exp(-z))
    else:
        score = F.lit(min(1.0, max(0.0, model.prior)))
    rows = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.cast("double").alias("score"), F.col("most").alias("max_gain"), F.col("total").alias("sum_gain"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "max_gain", "sum_gain")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
