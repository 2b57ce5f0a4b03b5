"""WARC archives with an index merged from locally sorted capture runs.

Writing: a record per page, built by SQL functions and written by Spark's text writer, whose line separator is the end
of a WARC record; archives may stand in any store that Spark writes to. Records are responses or, where an equal payload
of ``least_bytes`` or more has a smaller page_id, revisits with an empty block. An archive file takes as many records as
make about ``archive_bytes`` at the mean payload.

Reading: Spark's text reader streams each archive, record by record, so neither a file nor an archive is held as a
whole. Captures are gathered into runs of at most ``RUN_ROWS``, each sorted by (URL key, timestamp, page_id), with the
digest and size of the payload that was found. The runs are dealt out by ranges of that key of about ``RANGE_ROWS``
captures, and in each range a loser tree merges the k runs; the partitions one after the other are the captures in
global order, so a URL's history stands together. Ranges cut within a URL key, by timestamp, page_id and place, so that a
hot URL is spread too. Offsets and lengths count the bytes of an archive as they are before gzip.

The capture time is ``captured``, a timestamp column that the caller names; where it is null or not named, it is the
``EPOCH`` plus page_id modulo 2 ** 30 in seconds.

Defined results: null html counts as empty, a null url as an empty one; a null page_id is written as an empty identifier, read
back as null and never chosen as a response before a real one; rows that repeat a page_id are a record each, and all
rows with the smallest page_id of a payload are responses; an empty table gives an empty result; extra columns are
ignored, whatever their names. Line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, scratch_path, table

#: Bytes of payload of an archive, captures of a run and of a range of the merged index.
ARCHIVE_BYTES, RUN_ROWS, RANGE_ROWS = 256 << 20, 100_000, 250_000
EPOCH = 1_704_067_200
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
SEPARATOR = END.encode()
CAPTURE = "page_id long, urlkey string, captured string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long, intact boolean, run string"
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: four groups of 40 bits, each as 8 digits to base 32."""
    digest = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolved(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, first_id) of each distinct page_id and payload."""
    known = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n"))
    known = materialize(known.groupBy("page_id", "digest").agg(F.max("n").alias("n")), "warc-digests")
    first = known.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    return known.join(first, "digest").select("page_id", "digest", F.when(F.col("n") >= least_bytes, F.col("first_id")).otherwise(F.col("page_id")).alias("first_id"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, captured: str | None = None) -> None:
    """``pages`` has page_id, url and html; ``captured`` names its column of timestamps, if there is one."""
    at = F.timestamp_seconds(F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 30)) + EPOCH)
    if captured is not None:
        at = F.coalesce(F.col(captured).cast("timestamp"), at)
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"), at.alias("at"),
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
    )
    known = resolved(pages, least_bytes)
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    records = max(1, int(archive_bytes / (mean + 512)))
    keyed = pages.withColumn("digest", F.sha1("html")).withColumnRenamed("page_id", "own_id")
    joined = keyed.join(known, (keyed["digest"] == known["digest"]) & keyed["own_id"].eqNullSafe(known["page_id"])).drop("digest", "own_id")
    response = F.col("page_id").eqNullSafe(F.col("first_id"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: "),
        F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("html")), F.lit("\r\nWARC-Payload-Length: "), F.octet_length("html").cast("string"),
        F.when(response, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(response, F.octet_length("html").cast("string")).otherwise("0"), F.lit(END),
    )
    record = F.concat(header, F.when(response, F.col("html")).otherwise(F.lit("")))
    joined.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def url_key(url: str) -> str:
    """Host labels in reverse order, then the rest: captures of a site stand together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url, re.I)
    if not m:
        return url
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def page_of(value: str) -> int | None:
    found = value[len("<urn:page:") : -1]
    return int(found) if found else None


class Reader:
    """Captures of the archives that a task streams as chunks of text between separators, in order, archive by archive.

    A block may hold separators or begin one that its end completes, so the bytes are put together again; ``need`` tells
    how many are to come before anything can be read from them.
    """

    def __init__(self):
        self.archive, self.at = None, 0
        self.parts, self.have, self.need, self.headers, self.start = [], 0, 1, None, 0

    def feed(self, archive: str, chunk: str) -> Iterator[tuple]:
        if archive != self.archive:
            self.close()
            self.archive, self.at = archive, 0
        self.parts.append(chunk.encode() + SEPARATOR)
        self.have += len(self.parts[-1])
        while self.have >= self.need:
            data = b"".join(self.parts)
            self.parts = [data]
            if self.headers is None:
                stop = data.find(SEPARATOR)
                if stop < 0:
                    self.need = self.have + 1
                    return
                lines = data[:stop].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record at byte {self.at} of {archive}")
                self.headers = dict(x.split(": ", 1) for x in lines[1:])
                self.start = stop + len(SEPARATOR)
                self.need = self.start + int(self.headers["Content-Length"]) + len(SEPARATOR)
            else:
                end = self.need - len(SEPARATOR)
                if data[end : self.need] != SEPARATOR:
                    raise ValueError(f"the record at byte {self.at} of {archive} has another length than it says")
                yield self.capture(data[self.start : end])
                self.at += self.need
                self.parts, self.have, self.need, self.headers = [data[self.need :]], self.have - self.need, 1, None

    def capture(self, block: bytes) -> tuple:
        h = self.headers
        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
        intact = kind == "revisit" or base64.b32encode(hashlib.sha1(block).digest()).decode() == digest
        return (page_of(h["WARC-Record-ID"]), url_key(h["WARC-Target-URI"]), h["WARC-Date"], kind, digest, len(block) if kind == "response" else int(h["WARC-Payload-Length"]),
                page_of(h["WARC-Refers-To"]) if kind == "revisit" else None, self.archive, self.at, self.need, intact)

    def close(self) -> None:
        if self.headers is not None or b"".join(self.parts) not in (b"", SEPARATOR):  # the file's end may have been taken for one
            raise ValueError(f"the record at byte {self.at} of {self.archive} is cut off")
        self.parts, self.have, self.need = [], 0, 1


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], names=NAMES)


def capture_runs(spark: SparkSession, path: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Captures of the archives under ``path`` in sorted runs; ``run`` names each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = Reader(), []

        def sorted_run() -> pa.RecordBatch:
            name = f"{rows[0][7]}#{rows[0][8]}"
            return batch_of([(*r, name) for r in sorted(rows, key=order)])

        for batch in batches:
            for archive, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend(reader.feed(archive, chunk))
                if len(rows) >= run_rows:
                    yield sorted_run()
                    rows = []
        reader.close()
        if rows:
            yield sorted_run()

    # A gzip file is one split, whose lines come in order.
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_path").alias("archive"), "value").mapInArrow(read, CAPTURE)


def order(row: tuple) -> tuple:
    return (row[1], row[2], row[0] is not None, row[0] or 0, row[7], row[8])


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so a step replays one path of log2(k) nodes."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.keys = [None if h is None else order(h) for h in self.heads]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x <= y)

    def _replay(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            if self.losers[at] < 0:  # the first to arrive waits for its match
                self.losers[at] = winner
                return
            if self._beats(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = following = next(self.runs[winner], None)
            self.keys[winner] = None if following is None else order(following)
            self._replay(winner)


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order: the partitions one after the other, each in its own order.

    A task holds its range in Arrow columns; of each run it turns one row after the other into a tuple, for the tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        found = pa.Table.from_batches(held).combine_chunks()
        names = found.column("run").to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]

        def rows(start: int, stop: int) -> Iterator[tuple]:
            for at in range(start, stop, 500):
                yield from zip(*(c.to_pylist() for c in found.slice(at, min(500, stop - at)).columns))

        out: list[tuple] = []
        for row in LoserTree([rows(a, b) for a, b in zip(cuts, cuts[1:])]):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    key = ["urlkey", "captured", "page_id", "archive", "offset"]
    parts = max(1, -(-runs.count() // range_rows))
    # Within a range the parts of each run stand together, in their order; Spark sorts them, spilling where it must.
    return runs.repartitionByRange(parts, *key).sortWithinPartitions("run", *key).mapInArrow(run, CAPTURE).drop("run")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None, captured: str | None = None) -> DataFrame:
    """One row per page, in global order of captures: see ``CAPTURE`` (without the run)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least_bytes, captured=captured)
    return merge_index(materialize(capture_runs(spark, path), "warc-runs"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "offset", "length", "intact")
