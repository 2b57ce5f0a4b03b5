"""Order-dependent greedy clustering in parallel rounds, over a similarity join by prefixes.

The rule looks at one item after the other: it joins the first cluster, by the age of its founder, whose members are all
similar to it, else it founds one. Only similar items matter to each other, so the answer is found in rounds over the pairs of
similar items. In a round an item is settled if what its answer depends on is settled:

* its earlier similar items are looked at in order, those that joined others are passed by, and so is a founder whose cluster has
  a member that isn't similar to the item;
* an open one means waiting, as it may become a founder;
* at a founder whose cluster is all similar, the item joins, unless an earlier open item that isn't similar to it may join
  that cluster first; then it waits;
* at the end of the list the item founds a cluster.

The earliest open item can always be settled, so the rounds end, and with the answer of the sequential rule. What a round
compares are counts: members of a cluster before an item against those similar to it. A group with few similar pairs (counted
before) isn't worth rounds: one task looks at its items in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scratch import materialize

#: Similar pairs of a group up to which one task clusters it.
FEW_PAIRS = 200_000


def similar_pairs(sets: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """(grp, a, b) with a < b: sets of one group (grp, item, members) with a Jaccard similarity of num/den or more.

    Members are sorted by how many sets of the group have them, rare ones first. Sets this similar share a member among the first
    size - ceil(num/den * size) + 1 of each, and their sizes are within num/den, so only such pairs meet.
    """
    each = sets.select("grp", "item", F.explode("members").alias("member"))
    often = each.groupBy("grp", "member").agg(F.count(F.lit(1)).alias("often"))
    sorted_sets = each.join(often, ["grp", "member"]).groupBy("grp", "item").agg(F.array_sort(F.collect_list(F.struct("often", "member"))).alias("m"))
    sized = materialize(sorted_sets.select("grp", "item", F.col("m.member").alias("m"), F.size("m").alias("n")), "sorted-sets")
    first = F.slice("m", 1, F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("int") + 1)
    keyed = sized.withColumn("key", F.explode(first))
    one, two = (keyed.select("grp", "key", *[F.col(c).alias(f"{c}_{k}") for c in ("item", "m", "n")]) for k in "ab")
    near = (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")) & (F.col("item_a") < F.col("item_b"))
    met = one.join(two, ["grp", "key"]).where(near).dropDuplicates(["grp", "item_a", "item_b"])
    shared = F.size(F.array_intersect("m_a", "m_b"))
    return met.where(den * shared >= num * (F.col("n_a") + F.col("n_b") - shared)).select("grp", F.col("item_a").alias("a"), F.col("item_b").alias("b"))


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The items of a group's pairs with their founders, by the sequential rule: a cluster fits if all its members are similar."""
    before: dict[int, list[int]] = {}
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        before.setdefault(b, []).append(a)
        before.setdefault(a, [])
    founder: dict[int, int] = {}
    size: dict[int, int] = {}
    for item in sorted(before):
        alike: dict[int, int] = {}
        for a in before[item]:
            alike[founder[a]] = alike.get(founder[a], 0) + 1
        founder[item] = min((f for f, n in alike.items() if n == size[f]), default=item)
        size[founder[item]] = size.get(founder[item], 0) + 1
    return pd.DataFrame({"grp": pdf["grp"].iloc[0], "item": list(founder), "founder": list(founder.values())})


def greedy_clusters(items: DataFrame, pairs: DataFrame, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(grp, item, founder) for items (grp, item) that are looked at in the order of ``item``; pairs (grp, a, b) with a < b are similar."""
    keys = ["grp", "item"]
    pairs = materialize(pairs, "similar-pairs")
    few = materialize(pairs.groupBy("grp").count().where(F.col("count") <= few_pairs).select("grp"), "few-pairs")
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    small = pairs.join(few, "grp", "left_semi").groupBy("grp").applyInPandas(in_order, f"grp {kinds['grp']}, item {kinds['item']}, founder {kinds['item']}")
    pairs = pairs.join(few, "grp", "left_anti")
    # An item without a similar one founds a cluster, and so does one without an earlier one.
    small = materialize(small, "settled")
    linked = pairs.select("grp", F.col("b").alias("item")).distinct()
    rest = items.select(*keys).join(small, keys, "left_anti")
    settled = [small, materialize(rest.join(linked, keys, "left_anti").withColumn("founder", F.col("item")), "settled")]
    left = materialize(rest.join(linked, keys, "left_semi"), "open")
    while not left.isEmpty():
        known = settled[0]
        for more in settled[1:]:
            known = known.unionByName(more)
        state = known.unionByName(left.withColumn("founder", F.lit(None).cast(items.schema["item"].dataType)))
        # Of each open item b: its earlier similar items a with their founders (null: open).
        before = pairs.join(left.select("grp", F.col("item").alias("b")), ["grp", "b"], "left_semi").join(state.select("grp", F.col("item").alias("a"), F.col("founder").alias("of")), ["grp", "a"])
        before = materialize(before, "before")
        # Similar members of each cluster before b, and all of them: founders that b knows ask for the running count of members.
        alike = before.where("of is not null").groupBy("grp", "b", F.col("of").alias("f")).agg(F.count(F.lit(1)).alias("alike"))
        asked = before.where("of = a").select("grp", F.col("a").alias("f"), "b")
        line = asked.select("grp", "f", F.col("b").alias("at"), F.lit(0).alias("member"), F.lit(0).alias("waits"))
        line = line.unionByName(known.select("grp", F.col("founder").alias("f"), F.col("item").alias("at"), F.lit(1).alias("member"), F.lit(0).alias("waits")))
        line = line.groupBy("grp", "f", "at").agg(F.sum("member").alias("member"), F.count_if(F.col("member") == 0).alias("asks"))
        earlier = Window.partitionBy("grp", "f").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        counted = line.withColumn("members", F.coalesce(F.sum("member").over(earlier), F.lit(0))).withColumn("rivals", F.coalesce(F.sum("asks").over(earlier), F.lit(0)))
        counted = counted.where("asks > 0").select("grp", "f", F.col("at").alias("b"), "members", "rivals")
        fits = asked.join(counted, ["grp", "f", "b"]).join(alike, ["grp", "f", "b"]).where("members = alike").select("grp", "b", F.col("f").alias("a"), "rivals")
        # The first earlier item that is open, or a founder of a cluster that fits.
        opens = before.where("of is null").select("grp", "b", "a", F.lit(True).alias("waits"), F.lit(0).cast("long").alias("rivals"))
        first = opens.unionByName(fits.select("grp", "b", "a", F.lit(False).alias("waits"), F.col("rivals").cast("long"))).groupBy("grp", "b").agg(F.min(F.struct("a", "waits", "rivals")).alias("first"))
        first = left.select("grp", F.col("item").alias("b")).join(first, ["grp", "b"], "left").select("grp", "b", F.col("first.a").alias("f"), F.coalesce("first.waits", F.lit(False)).alias("waits"), "first.rivals")
        first = materialize(first.where("not waits").drop("waits"), "first")
        # Rivals: open earlier items similar to the founder. Those similar to b too do no harm.
        rivals = before.where("of is null").select("grp", "b", F.col("a").alias("k")).join(first.where("rivals > 0").select("grp", "b", "f"), ["grp", "b"])
        tame = rivals.join(pairs.select("grp", F.col("a").alias("f"), F.col("b").alias("k")), ["grp", "f", "k"], "left_semi").groupBy("grp", "b").agg(F.count(F.lit(1)).alias("tame"))
        chosen = first.join(tame, ["grp", "b"], "left").where("f is null or rivals = coalesce(tame, 0)")
        fresh = materialize(chosen.select("grp", F.col("b").alias("item"), F.coalesce("f", "b").alias("founder")), "settled")
        settled = [materialize(known.unionByName(fresh), "settled")] if len(settled) >= 8 else [*settled, fresh]
        left = materialize(left.join(fresh, keys, "left_anti"), "open")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out
