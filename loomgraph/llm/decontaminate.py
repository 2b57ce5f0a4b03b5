"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A seed is the hash of the words that a fixed mask selects from a stretch of words; positions of the mask that hold 0 are
ignored, so a substituted word there does not break the seed. Seeds of the benchmark and of the documents are joined.
Each hit gives a diagonal, an alignment of a document with an item. The hit is extended along its diagonal: all words of the
item are compared with the document's words beside them, and stretches that begin and end with agreeing words count if
they agree in ``share_percent`` of their places and in enough places (``STRETCH``, or fewer for an item of under 18
words). Where there are such stretches, the document repeats the item: a part of it, an item with substituted words, one cut
off by the document's end, or the parts beside an insertion, which lie on two diagonals. A stretch of 2 * n or more
agreeing words holds one of n to 2 * n - 1 in its share, so only these are looked for.

Words are runs of letters and digits in lower case. Items of fewer words than a mask are looked up as a whole, if they
have ``SHORTEST`` words at least; yet shorter items say too little and match nothing.

Rows are told apart by doc_id and a hash of the text. The benchmark's seeds are broadcast where their counted size
allows it; a larger benchmark is joined by a shuffle, by the same plan.

Defined results: null and empty texts (of documents or items) match nothing; a null doc_id is reported as null; repeated
rows are reported once per (doc_id, text, item_id), different texts of one doc_id once each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, texts

MASKS = ("110101101011", "101110011101", "111010010111")
SHORTEST, SHARE_PERCENT = 5, 70
#: Agreeing words of a stretch; of an item of up to 17 words its share of the item, but ``LEAST`` or the whole item.
STRETCH, LEAST = 13, 10
#: Up to so many benchmark words the benchmark's seeds are broadcast; a larger benchmark is joined by a shuffle.
BROADCAST_WORDS = 150_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeds(words: DataFrame, masks: list[str], *carried: str) -> DataFrame:
    """One row per place and mask: the carried columns, ``pos`` and ``seed``."""
    span = min(map(len, masks))

    def seed(number: int, mask: str) -> Column:
        picked = [F.col("words")[F.col("pos") + i] for i, bit in enumerate(mask) if bit == "1"]
        hashed = F.xxhash64(F.lit(number), *picked)
        return hashed if len(mask) == span else F.when(F.col("pos") + len(mask) <= F.size("words"), hashed)

    places = words.where(F.size("words") >= span).select(*carried, "words", F.explode(F.expr(f"sequence(0, size(words) - {span})")).alias("pos"))
    numbered = [seed(n, m) for n, m in enumerate(masks)]
    return places.select(*carried, "pos", F.explode(F.array(*numbered)).alias("seed")).where("seed is not null")


def whole_seeds(words: DataFrame, n: int, *carried: str) -> DataFrame:
    """Seeds of all stretches of ``n`` words, for items that are looked up as a whole."""
    places = words.where(F.size("words") >= n).select(*carried, "words", F.explode(F.expr(f"sequence(0, size(words) - {n})")).alias("pos"))
    return places.select(*carried, "pos", F.xxhash64(F.lit(100 + n), *[F.col("words")[F.col("pos") + i] for i in range(n)]).alias("seed"))


def least_agreeing(n: Column, share_percent: int, stretch: int) -> Column:
    """Agreeing words that a stretch of an item of ``n`` words must have."""
    share = F.ceil(n * share_percent / 100).cast("int")
    return F.least(n, F.lit(stretch), F.greatest(F.lit(LEAST), share))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, share_percent: int = SHARE_PERCENT, stretch: int = STRETCH, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Rows (doc_id, key, item_id, matched, compared, doc_word): documents that repeat a benchmark item, and where.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; key is xxhash64 of the document's text. Of several
    diagonals the one with most agreeing words in stretches that count is given, then the one with the fewest words from
    the first such stretch to the last (``compared``), then the earliest; doc_word is the document's word (from 0) at
    which the first stretch begins.
    """
    span = len(masks[0])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    sizes = items.groupBy(F.least(F.size("words"), F.lit(span)).alias("n")).agg(F.sum(F.size("words").cast("long")).alias("words")).collect()  # span + 1 rows at most
    short = [r["n"] for r in sizes if SHORTEST <= r["n"] < span]
    small = sum(r["words"] for r in sizes) <= broadcast_words
    bounded = F.broadcast if small else (lambda df: df)  # the size was counted above

    own = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    found, places = seeds(items, list(masks), "item_id"), seeds(own, list(masks), "doc_id", "key")
    for n in short:
        found = found.unionByName(whole_seeds(items.where(F.size("words") == n), n, "item_id"))
        places = places.unionByName(whole_seeds(own, n, "doc_id", "key"))
    found = found.withColumnRenamed("pos", "item_pos")
    # Only (doc_id, key, item_id, diagonal) is dealt out; words are fetched for the diagonals that hold hits.
    hits = places.join(bounded(found), "seed").select("doc_id", "key", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    hits = hits.join(bounded(items.withColumnRenamed("words", "item_words")), "item_id")
    text = texts(docs).select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"), "text")
    both = hits.join(text, hits["doc_id"].eqNullSafe(text["own_id"]) & (hits["key"] == text["own_key"]))
    # Places of the item, from 0, whose word agrees with the document's beside it.
    beside = lambda words: F.transform("item_words", lambda w, i: F.when((F.col("diagonal") + i >= 0) & (F.get(words, F.col("diagonal") + i) == w), i))
    same = F.element_at(F.transform(F.array(words_of(F.col("text"))), beside), 1)  # bound by a lambda, the words are split once
    both = both.select("doc_id", "key", "item_id", "diagonal", F.filter(same, lambda x: x.isNotNull()).alias("at"), least_agreeing(F.size("item_words"), share_percent, stretch).alias("least"))
    # One row for each diagonal; the aggregate also keeps what follows from being computed again and again inside the join.
    both = both.groupBy("doc_id", "key", "item_id", "diagonal").agg(F.first("at").alias("at"), F.first("least").alias("least")).where("size(at) >= least")
    # For each agreeing word, behind how many of them the longest stretch that begins with it ends (0: there is none).
    ends = F.expr(f"""transform(sequence(0, size(at) - 1), i -> coalesce(array_max(filter(sequence(least, 2 * least - 1),
        n -> i + n <= size(at) and 100 * n >= {share_percent} * (at[i + n - 1] - at[i] + 1))) + i, 0))""")
    both = both.select("doc_id", "key", "item_id", "diagonal", "at", ends.alias("ends"))
    # Words in stretches: those before which a stretch begins that reaches behind them.
    reach = F.expr("""aggregate(ends, named_struct('i', 0, 'reach', 0, 'n', 0, 'first', -1), (acc, e) -> named_struct(
        'i', acc.i + 1, 'reach', greatest(acc.reach, e), 'n', acc.n + if(greatest(acc.reach, e) > acc.i, 1, 0), 'first', if(acc.first < 0 and e > 0, acc.i, acc.first)))""")
    both = both.select("doc_id", "key", "item_id", "diagonal", "at", reach.alias("r"))
    first, last = F.get("at", F.col("r.first")), F.get("at", F.col("r.reach") - 1)  # null where there is no stretch
    judged = both.select("doc_id", "key", "item_id", F.col("r.n").cast("long").alias("matched"), (last - first + 1).cast("long").alias("compared"), (F.col("diagonal") + first).cast("long").alias("doc_word"))
    best = F.max(F.struct("matched", (-F.col("compared")).alias("compared"), (-F.col("doc_word")).alias("doc_word")))
    judged = judged.groupBy("doc_id", "key", "item_id").agg(best.alias("best")).where("best.matched > 0")
    return judged.select("doc_id", "key", "item_id", "best.matched", (-F.col("best.compared")).alias("compared"), (-F.col("best.doc_word")).alias("doc_word"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def _seed_sql(mask: str, at: str) -> str:
    return " || ' ' || ".join(f"words[{at} + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")


def _places_sql(source: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, words, pos, {n} AS mask, {_seed_sql(m, 'pos')} AS seed FROM (SELECT {key}, words, unnest(range(0, len(words) - {len(m) - 1})) AS pos FROM {source} WHERE len(words) >= {len(m)})"
        for n, m in enumerate(MASKS)
    )


#: For benchmarks whose items all have as many words as a mask or more: s holds each stretch, w its agreeing words.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM benchmark),
dp AS ({_places_sql('d', 'doc_id')}),
ip AS ({_places_sql('i', 'item_id')}),
h AS (SELECT DISTINCT doc_id, item_id, dp.pos - ip.pos AS diagonal FROM dp JOIN ip USING (mask, seed)),
p AS (SELECT h.*, x.place, i.words[x.place + 1] AS w, d.words AS dw, least(len(i.words), {STRETCH}, greatest({LEAST}, CAST(ceil(len(i.words) * {SHARE_PERCENT} / 100.0) AS INT))) AS least
      FROM h JOIN i USING (item_id) JOIN d USING (doc_id), LATERAL (SELECT unnest(range(0, len(i.words))) AS place) x),
a AS (SELECT doc_id, item_id, diagonal, least, place, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY place) AS k
      FROM p WHERE diagonal + place >= 0 AND diagonal + place < len(dw) AND dw[diagonal + place + 1] = w),
s AS (SELECT x.doc_id, x.item_id, x.diagonal, x.place AS a, y.place AS b FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.diagonal = y.diagonal AND y.k >= x.k
      WHERE y.k - x.k + 1 >= x.least AND 100 * (y.k - x.k + 1) >= {SHARE_PERCENT} * (y.place - x.place + 1) AND y.k - x.k + 1 < 2 * x.least),
w AS (SELECT a.doc_id, a.item_id, a.diagonal, count(DISTINCT a.place) AS matched, min(s.a) AS first, max(s.b) AS last
      FROM a JOIN s ON a.doc_id = s.doc_id AND a.item_id = s.item_id AND a.diagonal = s.diagonal AND a.place BETWEEN s.a AND s.b GROUP BY ALL),
k AS (SELECT *, last - first + 1 AS compared, diagonal + first AS doc_word FROM w)
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(compared AS BIGINT) AS compared, CAST(doc_word AS BIGINT) AS doc_word
FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, compared, doc_word) = 1
"""
