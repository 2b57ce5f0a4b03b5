"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct shingles as 64-bit hashes. The global n-gram order sorts shingles by how often they
occur (rare first, by levels of a count sketch over all documents), then by hash. It is cut into fragments; a document
sends the part of its set that a similar partner must meet (the prefix of the order) to the fragments it falls in. Each
fragment counts, apart from the others, the partial overlaps of the pairs that meet there; the counts are summed per
pair, and pairs that can't reach the threshold with what lies outside the prefixes are dropped. The others are verified
by their whole sets. No threshold, cap or sample loses a pair.

Documents with equal sets form one class, of which one representative takes part. Shingles of many classes would make
all pairs of their list; their lists stay relations. Rounds link the members of a list to one pivot and each class to its likeliest
partner, and only pairs between different components are looked at afterwards, so that a group of near copies costs
about its size, not its square. The last step verifies every pair between components that remains.

Classes are told apart by 63 bits of a hash of their set: among 10**9 classes the chance that any two are mistaken for one
another is about 5 %, and equal overlaps of different shingles are rarer still.

Defined results: null and empty texts, or texts without words, have no shingles and link with nothing; fewer words than
a shingle count as one whole sequence; a null doc_id takes part, but never names a component unless all its members are
null; repeated rows fall into one component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, discard_path, materialize, parts_for, release, scratch_path, slices, table, texts

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Buckets of the sketch, and the blocks that they are summed in.
SKETCH_BITS, BLOCKS = 22, 512
#: Tasks whose blocks are summed together.
TASKS_AT_ONCE = 256
#: Lists up to this length give their pairs in the fragment, longer ones stay relations.
SHORT_LIST = 24
#: Steps that the sketch's counts are told apart by around their mean, beside the half powers of two above it.
STEPS = 64
#: Prefix shingles of a fragment, and the level (256 times the mean sketch count) from which a shingle's list is dealt by class.
FRAGMENT_TOKENS, DEALT_LEVEL = 500_000, STEPS - 1 + 16
#: Pairs of places that a fragment looks at together.
PAIRS_AT_ONCE = 1_000_000
FILTER_BITS = 24
#: Rounds end when a row of a long list has so many partners in other components on average, or when they no longer get fewer.
FEW_PARTNERS = 256
#: Members of a long list that the last step looks at in one block.
BLOCK_MEMBERS = 1024
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Shingler:
    """Sorted distinct shingle hashes of texts, many texts at a time."""

    SEGMENT = 1 << 19  # bytes that are hashed together
    SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
    BYTES = np.random.default_rng(6).integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.class_hash = words, xxhash.xxh3_64_intdigest
        self.powers = np.ones(1, np.uint64)

    def word_hashes(self, data: bytes) -> np.ndarray:
        """Hashes of the words between white space (x20 and x09-x0D), in order."""
        out = []
        at = 0
        while at < len(data):
            stop = at + self.SEGMENT
            if stop < len(data):  # a segment ends behind a space
                found = re.compile(rb"[\x20\x09-\x0d]").search(data, stop)
                stop = found.end() if found else len(data)
            x = np.frombuffer(data[at:stop], np.uint8)
            at = stop
            inside = ~self.SPACE[x]
            starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
            if not len(starts):
                continue
            which = np.flatnonzero(inside)
            sizes = np.diff(np.r_[np.searchsorted(which, starts), len(which)])
            offset = which - np.repeat(starts, sizes)
            if (most := int(sizes.max())) > len(self.powers):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * most, MIX[0])], dtype=np.uint64)
            h = np.add.reduceat(self.BYTES[x[which]] * self.powers[offset], np.searchsorted(which, starts))
            out.append(mixed(h + sizes.astype(np.uint64) * MIX[2]))
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def sets(self, texts_in: list[str]) -> Iterator[np.ndarray]:
        """The set of each text, in order."""
        at = 0
        while at < len(texts_in):
            group, size = [], 0
            while at < len(texts_in) and (not group or size + len(texts_in[at]) <= self.SEGMENT):
                group.append(texts_in[at].encode().lower())
                size += len(group[-1])
                at += 1
            counts = [len(x.split()) for x in group]
            w = self.word_hashes(b"\n".join(group))
            ends = np.cumsum(counts)
            full = self._shingles(w, self.words)
            for end, n in zip(ends.tolist(), counts):
                if n >= self.words:
                    yield np.unique(full[end - n : end - self.words + 1])
                else:
                    yield self._shingles(w[end - n : end], n) if n else np.empty(0, np.uint64)

    @staticmethod
    def _shingles(w: np.ndarray, size: int) -> np.ndarray:
        if len(w) < size:
            return np.empty(0, np.uint64)
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h ^= h >> np.uint64(31)
            h *= MIX[i % 6]
            h += w[i : len(w) - size + 1 + i]
        return mixed(h)

    def key(self, tokens: np.ndarray) -> int:
        return self.class_hash(tokens.tobytes()) >> 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX[1]
    h = (h ^ (h >> np.uint64(29))) * MIX[3]
    return h ^ (h >> np.uint64(32))


def needed(n: np.ndarray | int, num: int, den: int):
    """Least overlap of a set of n shingles with any partner."""
    return -(-n * num // den)


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    """The sketch's bucket of each shingle."""
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def described(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class, key) of each document; (block, counts) of the sketch, in which a task counts a class once.

    A task's counts stop at 255, which is far above any mean that the levels are measured by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
        names = ["doc_id", "n", "class", "key", "block", "counts"]
        for batch in slices(batches):
            sizes, keys, fresh = [], [], []
            for t in shingler.sets(batch.column(1).to_pylist()):
                k = shingler.key(t)
                sizes.append(len(t))
                keys.append(k)
                if k not in seen:
                    seen.add(k)
                    fresh.append(bucket_of(t))
            if fresh:
                at, n = np.unique(np.concatenate(fresh), return_counts=True)
                sketch[at] = np.minimum(sketch[at] + n, 255)
            none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), batch.column(2), *none], names=names)
        blocks = sketch.reshape(BLOCKS, -1)
        some = np.flatnonzero(blocks.any(axis=1))
        none = [pa.nulls(len(some), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=names)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    both = materialize(keyed.mapInArrow(run, "doc_id long, n long, class long, key long, block int, counts binary"), "shingle-sets")
    return both.where("block is null").drop("block", "counts"), both.where("block is not null").select("block", "counts")


def levels_of(sketch: DataFrame) -> np.ndarray:
    """The level of each bucket; the sketch has 2 ** SKETCH_BITS counts at most. Blocks of many tasks are summed in two steps."""
    width = (1 << SKETCH_BITS) // BLOCKS

    def add(found: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint32)
        for r in found.column("counts").to_pylist():
            total += np.frombuffer(r, np.uint8 if len(r) == width else np.uint32)
        return pa.table([found.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    parts = -(-sketch.count() // (BLOCKS * TASKS_AT_ONCE))
    if parts > 1:
        sketch = sketch.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(parts))).groupBy("block", "part").applyInArrow(add, schema)
    counts = np.zeros(1 << SKETCH_BITS)
    for block, total in sketch.groupBy("block").applyInArrow(add, schema).collect():
        counts[block * width : (block + 1) * width] = np.frombuffer(total, np.uint32)
    return graded(counts)


def graded(counts: np.ndarray) -> np.ndarray:
    """Levels that rise with the counts: by their quantiles, and by half powers of two above the mean.

    In a large input a bucket's mean is far above the count of a shingle that some hundred documents share by chance. The
    quantiles still tell it from rare ones, as buckets differ by about the square root of the mean.
    """
    cuts = np.quantile(counts, np.arange(1, STEPS) / STEPS, method="lower")
    above = np.floor(2 * np.log2(np.maximum(counts / max(counts.mean(), 1.0), 1)))
    return (np.searchsorted(cuts, counts) + above).astype(np.uint8)


def overlaps(docs: DataFrame, levels: np.ndarray, total: int, words: int, num: int, den: int) -> DataFrame:
    """Partial overlaps of pairs in each fragment (token null), and the rows of long lists (b null).

    ``place`` is a shingle's place in the order of its set; of pairs, whether they share a shingle that can be their first
    common one, as enough of both sets stands behind it.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, total * (1 - num / den)) / FRAGMENT_TOKENS))))
    parts = 1 << bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        names = ["fragment", "tokens", "classes", "sizes", "places"]
        for batch in slices(batches, 8 << 20):
            tokens, classes, sizes, places = [], [], [], []
            for t in shingler.sets(batch.column(1).to_pylist()):
                k = shingler.key(t)
                if not len(t) or k in seen:
                    continue
                seen.add(k)
                p = len(t) - needed(len(t), num, den) + 1
                level = levels[bucket_of(t)]
                tokens.append(t[np.argsort(level, kind="stable")[:p]] if level.any() else t[:p])
                classes.append(np.full(p, k, np.int64))
                sizes.append(np.full(p, len(t), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if not tokens:
                continue
            t, c, s, i = map(np.concatenate, (tokens, classes, sizes, places))
            fragment = (t >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(t), np.int64)
            hot = levels[bucket_of(t)] >= DEALT_LEVEL
            fragment[hot] = parts + c[hot] % parts  # a list that may hold a large share of all classes is dealt by class
            order = np.argsort(fragment, kind="stable")
            cuts = np.flatnonzero(np.diff(fragment[order])) + 1
            rows = [(int(fragment[at[0]]), t[at].tobytes(), c[at].tobytes(), s[at].tobytes(), i[at].tobytes()) for at in np.split(order, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))], names=names)

    names = ["token", "a", "b", "n_a", "n_b", "shared", "place"]

    def count(found: pa.Table) -> pa.Table:
        joined = lambda i, kind: np.frombuffer(b"".join(found.column(i).to_pylist()), kind)
        t, c, s, p = joined(1, np.uint64), joined(2, np.int64), joined(3, np.int32).astype(np.int64), joined(4, np.int32).astype(np.int64)
        order = np.lexsort((c, t))
        t, c, s, p = t[order], c[order], s[order], p[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c, s, p = t[fresh], c[fresh], s[fresh], p[fresh]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        sizes = np.diff(np.r_[starts, len(t)])
        long = sizes > SHORT_LIST if found.column(0)[0].as_py() < parts else sizes > 0
        listed = np.repeat(long, sizes)
        tables = []
        for m in np.unique(sizes[~long & (sizes > 1)]):
            i, j = np.triu_indices(m, 1)
            base = starts[(sizes == m) & ~long]
            for at in np.array_split(base, -(-len(base) * len(i) // PAIRS_AT_ONCE)):
                tables.append(met((at[:, None] + i).ravel(), (at[:, None] + j).ravel(), c, s, p))
        none = pa.nulls(int(listed.sum()), pa.int64())
        tables.append(pa.table([pa.array(t[listed].astype(np.int64)), pa.array(c[listed]), none, pa.array(s[listed]), none, none, pa.array(p[listed])], names))
        return pa.concat_tables(tables)

    def met(left: np.ndarray, right: np.ndarray, c: np.ndarray, s: np.ndarray, p: np.ndarray) -> pa.Table:
        """A row for each pair of classes among the pairs of places, with the number of shingles that they share here."""
        alike = den * np.minimum(s[left], s[right]) >= num * np.maximum(s[left], s[right])
        left, right = left[alike], right[alike]
        early = np.minimum(s[left] - p[left], s[right] - p[right]) >= needed(s[left] + s[right], num, num + den)
        order = np.lexsort((c[right], c[left]))
        left, right, early = left[order], right[order], early[order]
        first = np.flatnonzero(np.r_[True, (c[left[1:]] != c[left[:-1]]) | (c[right[1:]] != c[right[:-1]])]) if len(left) else np.empty(0, np.int64)
        shared = np.diff(np.r_[first, len(left)])
        early = np.maximum.reduceat(early, first) if len(first) else early
        left, right = left[first], right[first]
        return pa.table([pa.nulls(len(left), pa.int64()), *(pa.array(x) for x in (c[left], c[right], s[left], s[right], shared, early.astype(np.int64)))], names)

    dealt = docs.mapInArrow(deal, "fragment int, tokens binary, classes binary, sizes binary, places binary")
    return materialize(dealt.groupBy("fragment").applyInArrow(count, ", ".join(f"{n} long" for n in names)), "partial-overlaps")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> tuple[str, str]:
    """Name of a table (class, tokens) of the wanted classes, in buckets by class, and the path of its files in the shared folder.

    A bit filter of a fixed size tells most unwanted classes; the join tells the rest.
    """
    bits = np.zeros(1 << FILTER_BITS, bool)
    slots = wanted.select((F.col("class") % (1 << FILTER_BITS)).cast("int").alias("slot")).distinct()
    packed = slots.groupBy((F.col("slot") / 4096).cast("int").alias("block")).agg(F.collect_list(F.col("slot") % 4096).alias("slots"))
    for block, found in packed.toLocalIterator():  # 2 ** FILTER_BITS slots at most
        bits[block * 4096 + np.array(found, np.int64)] = True
    filled = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, bits = Shingler(words), set(), np.unpackbits(filled)
        for batch in slices(batches):
            keys, sets = [], []
            for t in shingler.sets(batch.column(1).to_pylist()):
                k = shingler.key(t)
                if len(t) and k not in seen and bits[k % (1 << FILTER_BITS)]:
                    seen.add(k)
                    keys.append(k)
                    sets.append(t.astype(np.int64))
            if keys:
                offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], names=["class", "tokens"])

    spark = docs.sparkSession
    found = docs.mapInArrow(run, "class long, tokens array<long>").join(wanted, "class", "left_semi").dropDuplicates(["class"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"loomgraph_sets_{uuid.uuid4().hex}", scratch_path(spark, "sets")
    found.write.bucketBy(buckets, "class").option("compression", "none").option("path", path).saveAsTable(name)
    return name, path


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the threshold."""
    a = sets.select(F.col("class").alias("a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.select("a", "b").hint("shuffle_hash").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.select("a", "b", (F.size("tokens_a") + F.size("tokens_b")).alias("n"), common.alias("shared")).where(den * F.col("shared") >= num * (F.col("n") - F.col("shared"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(class, component): the smallest class reachable by links, for classes with links."""
    parts = parts_for(links.count())
    write = lambda df, name: materialize(df.coalesce(parts), name)
    edges = write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write(edges.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["class"]).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels["class"] == near["a"]).select("class", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("class").alias("component"), F.col("component").alias("top"))  # a label is a class too
        jumped = write(met.join(up, "component", "left").select("class", F.least("component", F.coalesce("top", "component")).alias("component"), "old"), "labels")
        labels = jumped.select("class", "component")
        if jumped.where("component <> old").isEmpty():
            return labels


def outside(n: Column, num: int, den: int) -> Column:
    """Shingles of a set that don't stand in its prefix."""
    return F.ceil(n * num / den) - 1


def reachable(shared: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Whether the overlap in the prefixes and all that lies outside one of them can reach the threshold."""
    return shared + F.greatest(outside(a, num, den), outside(b, num, den)) >= F.ceil((a + b) * num / (num + den))


def candidates(partial: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of short lists that can reach the threshold, with their summed overlaps, and the rows of long lists."""
    pairs = partial.where("token is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max("place").alias("early")).where("early = 1")
    lists = partial.where("b is null").select("token", F.col("a").alias("class"), F.col("n_a").alias("n"), "place")
    lists = materialize(lists.distinct(), "long-lists")  # a list that was dealt by class may hold a class twice
    held = lists.groupBy("class").agg(F.count(F.lit(1)).alias("held"))  # what a class may share besides, in long lists
    side = lambda c: held.select(F.col("class").alias(c), F.col("held").alias(f"held_{c}"))
    pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    besides = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    pairs = pairs.where(reachable(F.col("shared") + besides, F.col("n_a"), F.col("n_b"), num, den))
    found = materialize(pairs.select("a", "b", "shared", "n_a", "n_b"), "candidates"), materialize(lists.join(held, "class").withColumn("core", F.col("held") / F.col("n")).drop("held"), "long-lists")
    discard(lists)
    return found


def class_components(pairs: DataFrame, lists: DataFrame, sets: DataFrame, num: int, den: int, most_rounds: int = 12) -> DataFrame | None:
    """(class, component) of all classes that are linked; None if there is no link."""
    labels = links = None
    parts = parts_for(pairs.count() + lists.count())
    write = lambda df, name: materialize(df.coalesce(parts), name)

    def relabelled(rows: DataFrame, *keys: str) -> DataFrame:
        for k in keys:
            rows = rows.withColumn(f"c_{k}", F.col(k)) if labels is None else rows.join(labels.select(F.col("class").alias(k), F.col("component").alias(f"in_{k}")), k, "left").withColumn(f"c_{k}", F.coalesce(f"in_{k}", k)).drop(f"in_{k}")
        return rows

    def grow(candidates: DataFrame) -> None:
        nonlocal labels, links
        fresh = materialize(linked(candidates, sets, num, den), "links")
        if fresh.isEmpty():
            return
        links = fresh if links is None else links.unionByName(fresh)
        labels = components(links)
        release(sets.sparkSession)

    def meet(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
        """Whether a shared shingle at these places can be the first common one of a similar pair."""
        return F.least(n_a - at_a, n_b - at_b) >= F.ceil((n_a + n_b) * num / (num + den))

    similar = meet(F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place"))
    for k in range(most_rounds):
        rows = relabelled(pairs, "a", "b").where("c_a <> c_b")
        if k < 2:  # each class's likeliest partner
            likely = F.max(F.struct((F.col("shared") / (F.col("n_a") + F.col("n_b"))).alias("share"), "a", "b"))
            best = rows.groupBy(F.col("a").alias("of")).agg(likely.alias("p")).unionByName(rows.groupBy(F.col("b").alias("of")).agg(likely.alias("p"))).select("p.a", "p.b")
        else:
            best = rows.select("a", "b").limit(0)
        # Lists that lie in one component have nothing more to say.
        named = relabelled(lists, "class").withColumn("component", F.col("c_class")).drop("c_class")
        sizes = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
        named = write(named.join(sizes.where("m * m > same"), "token"), "open-lists")
        lists = named.select(*lists.columns)
        n, crossing = named.groupBy("token").agg(F.first("m").alias("m"), F.first("same").alias("same")).agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("same")) / 2), F.lit(0.0))).first()
        if k > 0 and crossing <= FEW_PARTNERS * n or k > 3 and crossing > 0.7 * before:
            break
        before = crossing
        # The first pivot is the member with the largest share of common shingles, as the source of a group's copies has.
        draw = -F.col("core") if k == 0 else F.xxhash64("class", F.lit(k)).cast("double")
        pivots = named.groupBy("token").agg(F.min(F.struct(draw.alias("draw"), "class", "n", "place", "component")).alias("pivot"))
        star = named.join(pivots, "token").where((F.col("component") != F.col("pivot.component")) & similar)
        star = star.select(F.least("class", "pivot.class").alias("a"), F.greatest("class", "pivot.class").alias("b"))
        tried = write(best.unionByName(star).distinct(), "tried")
        if tried.isEmpty():
            break
        grow(tried)
    else:
        named = relabelled(lists, "class").withColumnRenamed("c_class", "component")
    # Every pair between components that remains, of short lists and of long ones. Partners are of like length, so a list is
    # looked at by bands of lengths, and a band of many members in blocks: a member meets each block of its partners once.
    rows = relabelled(pairs, "a", "b").where("c_a <> c_b").select("a", "b")
    banded = named.withColumn("band", F.floor(F.log(F.col("n")) / math.log(den / num)).cast("int"))
    crowds = banded.groupBy("token", "band").agg(F.count(F.lit(1)).alias("m")).select("token", "band", (F.floor((F.col("m") - 1) / BLOCK_MEMBERS) + 1).cast("int").alias("blocks"))
    banded = banded.join(crowds, ["token", "band"])
    side = lambda k: [F.col("class").alias(k), F.col("n").alias(f"n_{k}"), F.col("place").alias(f"at_{k}"), F.col("component").alias(f"c_{k}")]
    left = banded.select("token", "band", F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block"), *side("a"))
    # The partner's own band or the next one below; it goes to all blocks of that band.
    right = banded.drop("blocks").withColumn("own", F.col("band")).withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    right = right.join(crowds, ["token", "band"]).select("token", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "own", *side("b"))
    once = (F.col("own") != F.col("band")) | (F.col("a") < F.col("b"))
    crossing = left.join(right, ["token", "band", "block"]).where(once & (F.col("c_a") != F.col("c_b")) & meet(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")))
    grow(materialize(rows.union(crossing.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "tried"))
    return labels


def ngram_components(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, key (xxhash64 of the text).

    Documents link when den * intersection >= num * union of their sets of ``words``-word shingles; component_id is the
    smallest doc_id reachable by links. ``docs`` has doc_id and text.
    """
    docs, spark = texts(docs), docs.sparkSession
    described_docs, sketch = described(docs, words)
    total = described_docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    partial = overlaps(docs, levels_of(sketch), total, words, num, den)
    release(spark)
    pairs, lists = candidates(partial, num, den)
    discard(partial)
    release(spark)
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(lists.select("class")).distinct()
    sets, path = sets_of(docs, wanted, words)
    release(spark)
    try:
        labels = class_components(pairs, lists, spark.table(sets), num, den)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {sets}")
        discard_path(spark, path)  # a table with a path of its own keeps its files when it is dropped
    discard(pairs)
    discard(lists)
    release(spark)
    smallest = described_docs.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least_id"))
    if labels is None:
        named = smallest.select("class", F.col("least_id").alias("component_id"))
    else:
        in_component = smallest.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
        of = in_component.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = in_component.select("class", "component").join(of, "component").select("class", "component_id")
    found = described_docs.join(named, "class", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).drop("key")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(min(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
