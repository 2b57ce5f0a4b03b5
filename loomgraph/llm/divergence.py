"""Source divergence audit: how far the word shares of the sources of a language lie apart.

Counting is done where the texts are read: a task keeps term counts for each (lang, source) it meets, in a table of bounded
size, and hands out sums. Terms in enough documents of a language form its vocabulary, which is dealt into chunks of about
``CHUNK`` terms. A group's counts of a chunk are packed into one row.

Pairs are computed by two-dimensional tiling: the groups of a language are dealt into blocks, and a tile is a pair of
blocks. Each packed row is replicated to the tiles of its block; a tile's task reads the rows sorted by chunk and adds the
chunk's share to its submatrix, so it holds one chunk of two blocks, whatever the size of the vocabulary. A term that a
group doesn't have still has a share (from smoothing), so a pair starts from V times the distance of these, and each
chunk corrects it.

Shares are whole numbers: p = 1 + floor(10^9 * (count + 5) / (N + 5*V)).

Defined results: null text, lang and source count as ''; a group without terms has the smoothed share of every kept term;
without kept terms a pair's value is 0; a group alone in its language has no pairs; repeated rows are documents of their
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, table

MIN_DOCUMENTS, SMOOTHING, PER = 30, 5, 1_000_000_000
TOP_TERMS = 50
#: Terms of a chunk and groups of a block, on average.
CHUNK, BLOCK = 4096, 16
#: Terms that a task counts before it hands out what it has.
HELD_TERMS = 400_000
#: A-Z to a-z, other ASCII but letters to a space; all other bytes stay.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def share(count, total, kept) -> Column:
    """p of a count, in whole numbers of any size."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    exact = lambda c: c.cast("decimal(19,0)")
    part = exact(count + SMOOTHING) * F.lit(PER).cast("decimal(10,0)")
    return F.call_function("div", part, exact(total + SMOOTHING * kept)) + 1


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of an array of counts: long division by three digits at a time, so 64 bits do up to totals of 9 * 10^15."""
    rest, by = counts.astype("i8") + SMOOTHING, total + SMOOTHING * kept
    out, rest = rest // by, rest % by
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // by, rest % by
    return out + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs), partial sums; the row with a null term tells that a group occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (seen, within) in counts.items():
                terms = list(seen)
                n = len(terms) + 1
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array([None, *terms], pa.binary()).cast(pa.string())]
                columns += [pa.array([0, *seen.values()], pa.int64()), pa.array([0, *(within[t] for t in terms)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])
            counts.clear()

        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                terms = text.as_py().translate(TO_TERMS).split()
                seen, within = counts.setdefault((lang, source), (Counter(), Counter()))
                size -= len(seen)
                seen.update(terms)
                within.update(set(terms))
                size += len(seen)
                if size > HELD_TERMS:
                    yield from flushed()
                    size = 0
        yield from flushed()

    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return plain.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(rows / F.lit(size)))


def vocabulary(sums: DataFrame, min_docs: int, chunk: int) -> DataFrame:
    """(lang, term, total, kept, lang_total, chunk, place, width) of the terms that a language keeps."""
    terms = sums.where("term is not null").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"))
    terms = materialize(terms.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    by_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    terms = terms.join(by_lang, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), blocks(F.col("kept"), chunk)))
    within = Window.partitionBy("lang", "chunk")
    return terms.repartition("lang", "chunk").withColumn("place", (F.row_number().over(within.orderBy("term")) - 1).cast("int")).withColumn("width", F.count(F.lit(1)).over(within).cast("int"))


def tiled_distances(packed: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources; ``packed`` and ``groups`` have lang, source and block."""
    head = groups.select("lang", "source", "block", "blocks", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("width"), "total", "kept", F.lit(None).cast("array<struct<place:int,count:long>>").alias("entries"))
    rows = head.unionByName(packed.select(*head.columns))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumn("row", F.least("block", "other")).withColumn("col", F.greatest("block", "other"))
    rows = rows.drop("blocks", "other").withColumn("places", F.col("entries.place")).withColumn("counts", F.col("entries.count")).drop("entries")
    order = ["lang", "row", "col", "chunk", "block", "source"]
    rows = rows.repartition("lang", "row", "col").sortWithinPartitions(*order).select(*order, "width", "total", "kept", "places", "counts")
    out = ["lang", "source", "item", "value"]

    def tile_rows(lang: str, sides: dict, matrix: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        """Both directions of each pair of a finished tile."""
        left, right = (list(side) for side in sides)
        for i, a in enumerate(left):
            at = [j for j in range(len(right)) if not same or j != i]
            if not at:
                continue
            names, values = [right[j] for j in at], matrix[i, at]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([a] * n), pa.array(names, pa.string()), pa.array(values)], names=out)
            if not same:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(names, pa.string()), pa.array([a] * n), pa.array(values)], names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = chunk = matrix = kept = None
        sides: list[dict[str, tuple[int, int]]] = [{}, {}]  # of rows and columns: source -> (its place, p of count 0)
        totals: dict[str, int] = {}
        held: list[tuple[str, bool, np.ndarray, np.ndarray, int]] = []

        def start_matrix() -> np.ndarray:
            first, second = (np.array([p for _, p in side.values()], "i8") for side in sides)
            return np.abs(first[:, None] - second[None, :]) * kept

        def add_chunk() -> None:
            """Replace the chunk's distances of the smoothed shares by those of the chunk's shares."""
            width = held[0][4]
            planes = [np.repeat(np.array([p for _, p in side.values()], "i8")[:, None], width, axis=1) for side in sides]
            for source, of_row, places, counts, _ in held:
                p = shares(counts, totals[source], kept)
                for k in (0, 1):
                    if source in sides[k] and (tile[1] == tile[2] or of_row == (k == 0)):
                        planes[k][sides[k][source][0], places] = p
            zero = [np.array([p for _, p in side.values()], "i8") for side in sides]
            for i in range(len(planes[0])):
                matrix[i] += np.abs(planes[1] - planes[0][i]).sum(axis=1) - np.abs(zero[1] - zero[0][i]) * width
            held.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            places, counts = batch.column(9), batch.column(10)
            for r, (lang, row, col, number, block, source, width, total, of_lang) in enumerate(zip(*columns)):
                if (lang, row, col) != tile or number != chunk:
                    if held:
                        add_chunk()
                    if (lang, row, col) != tile:
                        if tile and sides[0] and sides[1]:
                            yield from tile_rows(tile[0], sides, start_matrix() if matrix is None else matrix, tile[1] == tile[2])
                        tile, matrix, sides, totals = (lang, row, col), None, [{}, {}], {}
                    chunk = number
                if number < 0:
                    kept, totals[source] = of_lang, total
                    for k, own in ((0, row), (1, col)):
                        if block == own:
                            smoothed = int(shares(np.zeros(1, "i8"), total, kept)[0]) if kept else 0
                            sides[k][source] = (len(sides[k]), smoothed)
                    continue
                if matrix is None:
                    matrix = start_matrix()
                if sides[0] and sides[1]:
                    held.append((source, block == row, places[r].values.to_numpy(), counts[r].values.to_numpy(), width))
        if held:
            add_chunk()
        if tile and sides[0] and sides[1]:
            yield from tile_rows(tile[0], sides, start_matrix() if matrix is None else matrix, tile[1] == tile[2])

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank.

    ``docs`` has text, lang and source. Pairs: the summed distance to each other source of the language, all ranks. Terms:
    the terms that a source has more of than its language, by how much, the first ``top_terms``.
    """
    sums = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    sums = materialize(sums, "term-counts")
    terms = materialize(vocabulary(sums, min_docs, chunk), "vocabulary")
    counted = sums.where("term is not null").select("lang", "source", "term", "count").join(terms, ["lang", "term"])
    counted = materialize(counted, "kept-counts")
    names = sums.where("term is null").select("lang", "source")
    by_lang = names.groupBy("lang").agg(blocks(F.count(F.lit(1)), block).alias("blocks"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counted.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = names.join(totals, ["lang", "source"], "left").join(by_lang, "lang").join(kept, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.pmod(F.xxhash64("source"), "blocks").alias("block"), "blocks", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"))
    groups = materialize(groups, "groups")
    packed = counted.groupBy("lang", "source", "chunk", "width").agg(F.collect_list(F.struct("place", "count")).alias("entries"))
    packed = packed.join(groups, ["lang", "source"])
    pairs = tiled_distances(packed, groups).withColumn("part", F.lit("pair"))
    own = counted.join(groups.select("lang", "source", F.col("total").alias("own_total")), ["lang", "source"])
    p, q = share("count", "own_total", "kept"), share("total", "lang_total", "kept")
    over = own.where("count > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs).select(*out).unionByName(ranked(over).where(F.col("rank") <= top_terms).select(*out))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
t AS (SELECT id, lang, source, unnest(found) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS kept, CAST(sum(total) AS HUGEINT) AS lang_total FROM v GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v ON t.lang = v.lang AND t.term = v.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS own FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(n.own, 0) + 5 * l.kept) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (v.total + 5)) // (l.lang_total + 5 * l.kept) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, o.source AS item, sum(abs(p.p - o.p)) AS value
             FROM p JOIN p o ON o.lang = p.lang AND o.term = p.term GROUP BY p.lang, p.source, o.source) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms)
WHERE rank <= 50
"""
