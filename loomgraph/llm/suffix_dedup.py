"""Suffix-array dedup: repeated strings of ``length`` bytes are removed by longest-previous-factor arrays.

Suffixes that may repeat are brought together first. Each window of ``length`` bytes belongs to its anchor, the k-gram of
the smallest hash in it (the leftmost of equals); equal windows have equal anchors at equal places. A document sends
each anchor with a hash of its context, the bytes of all windows that belong to it. Anchors whose contexts are equal
repeat as a whole; contexts that differ though their anchor is the same go, as bytes, to a task that sorts the suffixes
which start in them. There the previous and next smaller positions in suffix order give each suffix its longest
earlier match (and, run backwards, its longest later one), and matches of ``length`` bytes or more are repeats.

``keep`` "none" removes each byte that a repeated string covers, "first" all but the first place of each string, by
(doc_id, start). Strings are judged on the input; overlaps count; matches never cross documents. Of rows that repeat
doc_id and text, "first" keeps one as if it stood alone; the others lose all that is as long as ``length``.

Anchors that a count sketch over all documents shows to be very frequent are dealt by context instead of by anchor, and
their windows are compared by hashes in a plain aggregation, so no task holds a hot anchor's places. Contexts and windows
are told apart by 128 bits: among 10**13 of them the chance that any two are mistaken for one another is under 10**-12.

Defined results: null and empty texts, and texts shorter than ``length``, lose nothing unless their bytes stand in a
repeated string, which they can't; a null doc_id sorts before all others; rows that repeat doc_id and text are documents of their own and
repeat each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, release, slices, table, texts

LENGTH, GRAM = 200, 64
CHUNK = 1 << 19
#: Windows of hot anchors that one task compares by their hashes.
HOT_WINDOWS = 1_000_000
SKETCH_BITS, HOT_LEVEL = 18, 8
#: Anchors of a fragment, and suffixes that are sorted together.
FRAGMENT_ANCHORS, FRAGMENT_SUFFIXES = 150_000, 40_000
NO_ID = -(2**63)
TABLE = np.random.default_rng(20).integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def anchors_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor and the first and last start of the windows that belong to it. ``gram`` is a power of two."""
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(data) - length + 1, CHUNK):
        x = TABLE[data[at : at + CHUNK + length - 1]]
        step, base = 1, BASE
        while step < gram:
            x = x[:-step] * np.uint64(base) + x[step:]
            step, base = 2 * step, base * base % 2**64
        x ^= x >> np.uint64(29)
        x *= MIX
        x ^= x >> np.uint64(32)
        width = length - gram + 1
        y = (x & ~np.uint64(0xFFFFF)) | np.arange(len(x), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            y = np.minimum(y[:-span], y[span:])
            span *= 2
        if rest := width - span:
            y = np.minimum(y[:-rest], y[rest:])
        p = (y & np.uint64(0xFFFFF)).astype(np.int64)
        lo = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1]
        hi = np.r_[lo[1:] - 1, len(p) - 1]
        chosen = x[p[lo]] * MIX  # the smallest hashes are chosen; spread them again
        for into, values in zip(out, (chosen ^ (chosen >> np.uint64(32)), lo + at, hi + at)):
            into.append(values)
    if not out[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, out))


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place of a smaller value, or -1. Between the two all values are larger."""
    at = np.arange(-1, len(values) - 1)
    while True:
        past = np.flatnonzero((at >= 0) & (values[at] > values))
        if not len(past):
            return at
        at[past] = at[at[past]]


def longest_previous(windows: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Length of the longest match with a suffix of a smaller position, at most the windows' width.

    ``windows`` is a matrix with the first bytes of each suffix. In suffix order the best earlier match of a suffix is
    its previous or its next smaller position.
    """
    width = windows.shape[1]
    keys = np.ascontiguousarray(windows).view(f"S{width}").ravel()
    order = np.lexsort((positions, np.unique(keys, return_inverse=True)[1]))
    place = positions[order]
    before = smaller_before(place)
    after = len(place) - 1 - smaller_before(place[::-1])[::-1]

    def common(other: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), np.int64)
        a, b = windows[order[there]], windows[order[other[there]]]
        differ = a != b
        out[there] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        return out

    factor = np.empty(len(order), np.int64)
    factor[order] = np.maximum(common(before, before >= 0), common(after, after < len(place)))
    return factor


def repeats(windows: np.ndarray, positions: np.ndarray, keep: str) -> np.ndarray:
    """Which of the suffixes have an earlier match of full width, or with ``keep`` "none" also a later one."""
    width = windows.shape[1]
    found = longest_previous(windows, positions) >= width
    return found if keep == "first" else found | (longest_previous(windows, -positions) >= width)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of rows with equal values."""
    n = len(columns[0])
    changed = np.zeros(max(0, n - 1), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    starts = np.flatnonzero(np.r_[True, changed]) if n else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, n])


FIELDS = (("anchor", np.uint64), ("context", np.uint64), ("more", np.uint64), ("doc", np.int64), ("key", np.int64), ("lo", np.int64), ("hi", np.int64), ("state", np.int8))
ONE, KNOWN, DECIDED = 1, 2, 3  # a place; one of several equal places; a place that is a repeat already
SPAN, COLD, HOT = 0, 1, 2


def sketched(keyed: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Levels of the anchors' count sketch (2 ** SKETCH_BITS rows at most), and the number of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            found = [anchors_of(np.frombuffer(x.encode(), np.uint8), length)[0] for x in batch.column(0).to_pylist()]
            if found:
                counts += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    counts = np.zeros(1 << SKETCH_BITS)
    for bucket, n in keyed.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return np.floor(np.log2(np.maximum(counts / max(1.0, counts.mean()), 1))).astype(np.uint8), int(counts.sum())


def matched_anchors(keyed: DataFrame, levels: np.ndarray, total: int, length: int, keep: str) -> DataFrame:
    """(kind, doc_id, key, lo, hi, anchor): repeated spans [lo, hi), and contexts whose suffixes must be sorted."""
    bits = max(0, int(np.ceil(np.log2(max(1, total) / FRAGMENT_ANCHORS))))
    parts = 1 << bits
    names = ["fragment", *(n for n, _ in FIELDS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in slices(batches):
            columns: dict[str, list] = {n: [] for n, _ in FIELDS}
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                anchor, lo, hi = anchors_of(np.frombuffer(data, np.uint8), length)
                if not len(anchor):
                    continue
                context = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())]), np.uint64)
                values = (anchor, context[::2], context[1::2], np.full(len(lo), NO_ID if doc is None else doc), np.full(len(lo), key), lo, hi, np.ones(len(lo), np.int8))
                for (n, _), v in zip(FIELDS, values):
                    columns[n].append(v)
            if not columns["lo"]:
                continue
            f = {n: np.concatenate(v) for n, v in columns.items()}
            # Equal contexts of a part: the first goes on for all.
            order = np.lexsort((f["lo"], f["doc"], f["more"], f["context"]))
            f = {n: v[order] for n, v in f.items()}
            starts, sizes = runs(f["context"], f["more"])
            f["state"][:] = np.repeat(np.where(sizes > 1, DECIDED, ONE), sizes)
            f["state"][starts[sizes > 1]] = KNOWN
            fragment = (f["anchor"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(order), np.int64)
            hot = levels[(f["anchor"] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] >= HOT_LEVEL
            fragment[hot] = parts + (f["context"][hot] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(fragment, kind="stable")
            rows = [[int(fragment[at[0]]), *(f[n][at].tobytes() for n, _ in FIELDS)] for at in np.split(order, np.flatnonzero(np.diff(fragment[order])) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(len(names))], names=names)

    def match(found: pa.Table) -> pa.Table:
        hot = found.column(0)[0].as_py() >= parts
        f = {n: np.frombuffer(b"".join(found.column(i + 1).to_pylist()), kind) for i, (n, kind) in enumerate(FIELDS)}
        done = f["state"] == DECIDED
        decided = {n: v[done] for n, v in f.items()}
        f = {n: v[~done] for n, v in f.items()}
        order = np.lexsort((f["lo"], f["doc"], f["more"], f["context"], f["anchor"]))
        f = {n: v[order] for n, v in f.items()}
        starts, sizes = runs(f["anchor"], f["context"], f["more"])
        first = np.zeros(len(order), bool)
        first[starts] = True
        several = np.repeat((sizes > 1) | (np.maximum.reduceat(f["state"], starts) == KNOWN if len(starts) else sizes > 1), sizes)
        span = several & ~first if keep == "first" else several
        # Anchors with more than one context, one of which is still to be matched.
        _, places = runs(f["anchor"])
        group = np.repeat(np.arange(len(places)), places)
        contexts = np.bincount(group, weights=first, minlength=len(places))
        single = np.bincount(group, weights=first & (~several | (keep == "first")), minlength=len(places))
        asked = first & (hot | ((contexts > 1) & (single > 0))[group]) if len(group) else first
        parts_of = [(SPAN, decided, slice(None), length), (SPAN, f, span, length), (HOT if hot else COLD, f, asked, 0)]
        tables = []
        for kind, g, pick, more in parts_of:
            lo = g["lo"][pick]
            tables.append(pa.table([pa.array(np.full(len(lo), kind, np.int32)), *(pa.array(x) for x in (g["doc"][pick], g["key"][pick], lo, g["hi"][pick] + more, g["anchor"][pick].astype(np.int64)))], ["kind", "doc", "key", "lo", "hi", "anchor"]))
        return pa.concat_tables(tables)

    dealt = keyed.select("doc_id", "key", "text").mapInArrow(deal, "fragment int, " + ", ".join(f"{n} binary" for n, _ in FIELDS))
    return materialize(dealt.groupBy("fragment").applyInArrow(match, "kind int, doc long, key long, lo long, hi long, anchor long"), "matched-anchors")


def sorted_suffixes(keyed: DataFrame, asked: DataFrame, length: int, keep: str) -> DataFrame:
    """(doc, key, lo, hi): repeated spans among the windows of the asked contexts."""
    by_anchor = asked.groupBy("anchor").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    starts = by_anchor.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-int(starts) // FRAGMENT_SUFFIXES))
    many = by_anchor.where(F.col("n") > FRAGMENT_SUFFIXES).select("anchor", F.lit(HOT).alias("hot"))
    asked = asked.join(many, "anchor", "left").withColumn("kind", F.coalesce("hot", "kind")).drop("hot")
    by_doc = asked.groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "hi", "anchor", "kind")).alias("asked"))
    here = keyed.join(by_doc, ["doc", "key"]).select("doc", "key", "text", "asked")
    names = ["doc", "key", "lo", "hot", "fragment", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, key, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                rows.extend((doc, key, w["lo"], w["kind"] == HOT, w["anchor"] % parts, data[w["lo"] : w["hi"] + length]) for w in wanted)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=names)

    contexts = materialize(here.mapInArrow(cut, "doc long, key long, lo long, hot boolean, fragment long, bytes binary"), "contexts")
    release(keyed.sparkSession)
    schema = "doc long, key long, lo long, hi long"

    def suffixes(found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Doc, key and start of each suffix, and the matrix of their first bytes."""
        doc, key, lo = (found.column(i).to_numpy() for i in range(3))
        matrices = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), length) for x in found.column(5).to_pylist()]
        sizes = np.array([len(m) for m in matrices])
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(doc, sizes), np.repeat(key, sizes), np.repeat(lo, sizes) + within, np.concatenate(matrices)

    def spans(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> pa.Table:
        """Starts that follow each other make one span."""
        order = np.lexsort((start, key, doc))
        doc, key, start = doc[order], key[order], start[order]
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.empty(0, np.int64)
        last = np.r_[cuts[1:], len(doc)] - 1 if len(cuts) else cuts
        return pa.table([pa.array(x) for x in (doc[cuts], key[cuts], start[cuts], start[last] + length)], ["doc", "key", "lo", "hi"])

    def search(found: pa.Table) -> pa.Table:
        doc, key, start, windows = suffixes(found)
        positions = np.empty(len(doc), np.int64)
        positions[np.lexsort((start, key, doc))] = np.arange(len(doc))
        again = repeats(windows, positions, keep)
        return spans(doc[again], key[again], start[again])

    hot_parts = max(1, -(-int(starts) // HOT_WINDOWS))
    fields = (("window", np.uint64), ("more", np.uint64), ("doc", np.int64), ("key", np.int64), ("lo", np.int64), ("hi", np.int64), ("n", np.int64))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of places by window hash: one for each distinct window of a part, and the spans that repeat inside it (n = 0)."""
        import xxhash

        for batch in slices(batches, 256 << 10):  # a context's windows take some fifty times its bytes
            if not batch.num_rows:
                continue
            doc, key, start, windows = suffixes(batch)
            both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in np.ascontiguousarray(windows)]), np.uint64)
            w, m = both[::2], both[1::2]
            order = np.lexsort((start, doc, m, w))
            at, sizes = runs(w[order], m[order])
            again = np.repeat(sizes > 1, sizes)
            if keep == "first":
                again[at] = False
            one, own = spans(doc[order][again], key[order][again], start[order][again]), order[at]
            known = {c: one.column(c).to_numpy() for c in ("doc", "key", "lo", "hi")} | {"window": one.column("lo").to_numpy().astype(np.uint64), "more": np.zeros(len(one), np.uint64), "n": np.zeros(len(one), np.int64)}
            fresh = {"window": w[own], "more": m[own], "doc": doc[own], "key": key[own], "lo": start[own], "hi": start[own] + length, "n": sizes}
            f = {n: np.concatenate([known[n], fresh[n]]) for n, _ in fields}
            fragment = f["window"] % np.uint64(hot_parts)
            order = np.argsort(fragment, kind="stable")
            rows = [[int(fragment[x[0]]), *(f[n][x].tobytes() for n, _ in fields)] for x in np.split(order, np.flatnonzero(np.diff(fragment[order])) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(len(fields) + 1)], names=["fragment", *(n for n, _ in fields)])

    def settle(found: pa.Table) -> pa.Table:
        """The spans of a fragment's windows that stand in several places."""
        f = {n: np.frombuffer(b"".join(found.column(i + 1).to_pylist()), kind) for i, (n, kind) in enumerate(fields)}
        order = np.lexsort((f["key"], f["lo"], f["doc"], f["more"], f["window"], f["n"] > 0))
        f = {n: v[order] for n, v in f.items()}
        decided = int((f["n"] == 0).sum())
        at, sizes = runs(f["window"][decided:], f["more"][decided:])
        again = np.repeat(np.add.reduceat(f["n"][decided:], at) > 1, sizes) if len(at) else np.empty(0, bool)
        if keep == "first":
            again[at] = False
        pick = np.r_[np.ones(decided, bool), again]
        return pa.table([pa.array(f[n][pick]) for n in ("doc", "key", "lo", "hi")], ["doc", "key", "lo", "hi"])

    cold = contexts.where("not hot").groupBy("fragment").applyInArrow(search, schema)
    hot = contexts.where("hot").mapInArrow(hashed, "fragment long, " + ", ".join(f"{n} binary" for n, _ in fields))
    return cold.unionByName(hot.groupBy("fragment").applyInArrow(settle, schema))


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """One row per document: doc_id, text, spans (array of [lo, hi) in bytes, not merged; null where there are none)."""
    every = keyed = texts(docs).withColumn("key", F.xxhash64("text"))
    if keep == "first":
        keyed = keyed.dropDuplicates(["doc_id", "key"])  # one row of each takes part
    levels, total = sketched(keyed, length)
    found = matched_anchors(keyed, levels, total, length, keep)
    release(docs.sparkSession)
    every, keyed = (df.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))) for df in (every, keyed))
    sorted_ones = sorted_suffixes(keyed, found.where(f"kind <> {SPAN}"), length, keep)
    spans = found.where(f"kind = {SPAN}").select("doc", "key", "lo", "hi").unionByName(sorted_ones).distinct()
    spans = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = every.join(spans, ["doc", "key"], "left")
    if keep == "first":
        copy = F.row_number().over(Window.partitionBy("doc", "key").orderBy(F.lit(1)))
        n_bytes = F.octet_length("text").cast("long")
        whole = F.when(n_bytes >= length, F.array(F.struct(F.lit(0).cast("long").alias("lo"), n_bytes.alias("hi"))))
        out = out.withColumn("copy", copy).withColumn("spans", F.when(F.col("copy") == 1, F.col("spans")).otherwise(whole))
    return out.select("doc_id", "text", "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep: str = "none", with_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes that stay)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in names[1:]]
            for text, lo, hi in zip(*(c.to_pylist() for c in batch.columns[1:])):
                data = text.encode()
                cut = merged(list(zip(lo, hi))) if lo else []
                edges = [0, *(x for span in cut for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for into, value in zip(out, (len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept)):
                    into.append(value)
            arrays = [batch.column(0), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(arrays if with_bytes else arrays[:-1], names=names if with_bytes else names[:-1])

    flat = repeated_spans(docs, length, keep).select("doc_id", "text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    return flat.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else ""))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
