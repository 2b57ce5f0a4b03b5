"""Packing documents into token sequences by Karmarkar-Karp multiway differencing.

Tokenisation runs once, in Arrow batches; a document's ids are cut into whole windows of ``capacity`` ids and a
remainder of pieces of at most ``max_piece`` ids. Whole windows are sequences of their own. The other pieces (not their
ids) are dealt by a hash of their place in the table of pieces, so evenly whatever they hold, into groups of about
``group_pieces``; within a group the differencing method merges partial partitions with opposing imbalances into
near-equal windows, and the number of windows rises while one of them exceeds the capacity.

Defined results: null and empty texts hold only the end id; repeated rows are packed once each; an empty table gives an
empty result; very long texts become many whole windows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table, texts

CAPACITY, END_ID, MAX_PIECE, GROUP_PIECES = 4096, 2, 1024, 768
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 800_000
#: Sequence ids: groups have room for so many windows each, below the whole windows, whose ids begin at WHOLE.
GROUP_ROOM, WHOLE = 1 << 20, 1 << 61

#: Texts of these characters alone are split into words here and looked up word by word; others go to the library whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ÿŒœŠšŸŽž]*")
#: The tokenizer's own split of a text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Ids of a text as the tokenizers library gives them, with the ids of strings between white space kept in memory."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(WORDS).findall
        self.known: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _string(self, string: str) -> bytes:
        """A string without white space is one word or several."""
        if string.isascii() and string.isalpha():
            return self._ids(string)
        known = self.known
        return b"".join([known[w] if w in known else known.setdefault(w, self._ids(w)) for w in self.find(string)])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" in text or not PLAIN.fullmatch(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        strings, known = text.lower().split(), self.known
        try:
            return b"".join([known[s] for s in strings])
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for s in strings:
                if s not in known:
                    known[s] = self._string(s)
            return b"".join([known[s] for s in strings])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return WordEncoder(path)


def cut_points(n: int, capacity: int, max_piece: int) -> Iterator[tuple[int, int]]:
    """(start, length): whole windows first, then pieces of the remainder of nearly equal lengths."""
    whole = n // capacity * capacity
    for start in range(0, whole, capacity):
        yield start, capacity
    if rest := n - whole:
        parts = -(-rest // max_piece)
        edges = [whole + rest * i // parts for i in range(parts + 1)]
        yield from ((a, b - a) for a, b in zip(edges, edges[1:]))


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for)."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                for start, length in cut_points(n, capacity, max_piece):
                    part = ids[4 * start : 4 * (start + length)]
                    for col, value in zip(out, (doc_id, start, length, zlib.crc32(part), n, np.frombuffer(part, "<u4").tolist() if with_ids else None)):
                        col.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:5]] + ([pa.array(out[5], pa.list_(pa.int64()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    return texts(docs).mapInArrow(run, schema)


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for ``k`` parts: positions of ``lengths`` in each part, with near-equal sums.

    Every number starts as a partition with one filled part; the two partitions of the largest spread are merged,
    the largest part of one with the smallest of the other, until one partition is left.
    """
    if k == 1:
        return [list(range(len(lengths)))]
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for i, n in enumerate(lengths):
        heap.append((-n, i, [(n, [i])]))  # parts of sum 0 at the end are left out
    heapq.heapify(heap)
    count = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            merged = sorted(a + b, key=lambda p: -p[0])
        else:
            free = k - len(a)  # empty parts of a take b's largest parts
            merged = a + b[:free]
            for j, (n, members) in enumerate(b[free:]):
                at = len(a) - 1 - j
                merged[at] = (a[at][0] + n, a[at][1] + members)
            merged.sort(key=lambda p: -p[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(n - low, members) for n, members in merged]
        heapq.heappush(heap, (-merged[0][0], count, merged))
        count += 1
    return [members for _, members in heap[0][2]] if heap else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises whenever one exceeds it."""
    if not lengths:
        return []
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        parts = differencing(lengths, k)
        if max(sum(lengths[i] for i in p) for p in parts) <= capacity:
            return parts
        k += 1


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, group_pieces: int = GROUP_PIECES, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # The places are those in written files, so a task that runs again numbers its rows as before.
    cut = materialize(pieces(docs, tokenizer, capacity, max_piece, end_id), "pieces").withColumn("place", F.monotonically_increasing_id())
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(WHOLE) + F.col("place")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for w, members in enumerate(windows(lengths.tolist(), capacity)):
            own = np.sort(members)
            sequence[own], offset[own] = w, np.cumsum(lengths[own]) - lengths[own]
        pdf["sequence_id"] = pdf["grp"].astype("int64") * GROUP_ROOM + sequence
        pdf["offset"] = offset
        return pdf.drop(columns=["grp", "place"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return whole.drop("place").unionByName(dealt(rest, groups).groupBy("grp").applyInPandas(one, schema))


def dealt(rest: DataFrame, groups: int) -> DataFrame:
    return rest.withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(groups)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
