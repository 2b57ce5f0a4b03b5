"""Findings out of script summaries, JSON texts of no fixed schema, read as variants.

``summaries`` has (package, summary).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import any_of, ladder
from loomgraph.functions.variants import exploded

# Texts that tell a translation of codes, and texts that tell an operational constant.
SUBSTANTIAL = (
    "many when", "large case", "numerous when", "explicit mapping", "→", "->", "maps ", "map to", "code translation", "code values", "payee type", "event cause", "benefit code", "benefit codes",
    "benefit description", "coverage type", "coverage code", "coverage level", "lob type", "class of business", "class_of_business", "gross benefit code", "payment status", "amount type", "premium mode",
    "mode mapping", "carrier name", "company name", "address", "policy prefix", "line-of-business", "line of business", "product line", "option",
)
OPERATIONAL = (
    "= 'y'", "= 'n'", "= 'paid'", "= 'void'", "= 'pacs'", "= 'cv'", "= 'eis'", "= 'mgis'", "= 'tpa'", "= 'vue'", "= 'claims'", "= 'main'", "= 'mailing'", "nvl(", "coalesce(", "1900-01-01", "31-dec-99",
    "31-dec-2999", "to_date(", "= -1", " -1)", "n_version_number", "n_batch_id", "v_created_by", "v_last_modified_by", "v_source_system_name_r = ", "parallel rebuild", "surrogate", "set to 0", "snapshot_id",
    "partition name", "days elapsed", "trunc(d_", "trunc(d_completed", "trunc(d_created", "sysdate - trunc", "d_due_date_r", "n_national_account", "v_individual_or_org_ind", "fein", "v_ach_payment_ind",
    "ach payment", "month name", "january",
)
DEFAULTS, MAPPINGS = ("nvl(", "coalesce(", "default", "1900-01-01", "31-dec"), ("case", "decode", "mapping", "map", "→", "->")
EXCLUSIONS, FILTERS, SMALL = ("exclusion", "exclude", "excluded", "not in"), ("filter", "where"), ("Y", "N", "1", "0")
BRANCHES, VALUES = 5, 4


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def logic_entries(summaries: DataFrame) -> DataFrame:
    """(package, at, kind, n_values, substantial): each entry on hard-coded logic, a text or an object with a number of branches."""
    logic = summaries.select("package", F.explode(F.array(F.try_variant_get(F.try_parse_json("summary"), "$.TRANSFORMATION_SUMMARY.hardcoded_logic", "variant"))).alias("v"))
    listed = F.when(F.schema_of_variant("v") == "STRING", F.array("v")).otherwise(F.try_variant_get("v", "$", "array<variant>"))
    entries = logic.select("package", F.posexplode(listed).alias("at", "e"))
    kind = F.schema_of_variant("e")
    one = F.struct(F.when(kind == "STRING", F.try_variant_get("e", "$", "string")).alias("text"), F.try_variant_get("e", "$.approx_branch_count", "double").alias("branches"), kind.startswith("OBJECT").alias("is_object"))
    entries = entries.select("package", "at", F.explode(F.array(one)).alias("x")).select("package", "at", "x.*")  # evaluated once
    low = F.lower("text")
    values = F.filter(F.regexp_extract_all("text", F.lit(r"'([^']{1,40})'"), F.lit(1)), lambda v: (F.trim(v) != "") & ~v.isin(*SMALL))
    operational = holds_any(low, OPERATIONAL)
    by_text = ladder(
        [(operational & holds_any(low, DEFAULTS), "DEFAULT_VALUE"), (operational, "CONSTANT_FILTER"), (holds_any(low, MAPPINGS), "VALUE_MAPPING"), (holds_any(low, EXCLUSIONS), "EXCLUSION_LIST"), (holds_any(low, FILTERS), "CONSTANT_FILTER")],
        "INLINE_LOGIC",
    )
    is_text = F.col("text").isNotNull()
    substantial = F.when(is_text, (holds_any(low, SUBSTANTIAL) | (F.size(values) >= VALUES)) & ~operational).otherwise(F.coalesce("branches", F.lit(0)) >= BRANCHES)
    return entries.where(is_text | F.col("is_object")).select("package", "at", F.when(is_text, by_text).otherwise("VALUE_MAPPING").alias("kind"), F.when(is_text, F.size(values)).otherwise(0).alias("n_values"), substantial.alias("substantial"))


def hard_coded(summaries: DataFrame) -> DataFrame:
    """(package, n_entries, n_mappings): packages with a substantial mapping or exclusion."""
    wanted = F.col("kind").isin("VALUE_MAPPING", "EXCLUSION_LIST") & F.col("substantial")
    return logic_entries(summaries).groupBy("package").agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(wanted).alias("n_mappings")).where("n_mappings > 0")


def bulk_passes(summaries: DataFrame) -> DataFrame:
    """(package, n_cursors, n_updates): packages that collect in bulk and update in loops, by what they say of cursors and bulk work."""
    flow = F.try_variant_get(F.try_parse_json("summary"), "$.PROCESS_FLOW", "map<string, string>")
    about = F.filter(F.map_entries(flow), lambda e: F.lower(e["key"]).rlike("cursor|bulk"))
    text = F.array_join(F.transform(about, lambda e: e["value"]), " ", "")
    upper = F.upper("text")
    found = summaries.select("package", text.alias("text")).where(upper.contains("BULK COLLECT") & upper.contains("FORALL") & upper.contains("UPDATE"))
    count = lambda pattern: F.greatest(F.lit(1), F.regexp_count("text", F.lit(pattern)))
    return found.select("package", count(r"(?i)OPEN\s+\w+|CURSOR\s+\w+\s+IS").alias("n_cursors"), count(r"(?is)FORALL.{1,50}UPDATE").alias("n_updates"))


# Parts of keys that hold findings, and beginnings of keys that hold metadata.
FINDING_KEYS = ("issue", "risk", "bug", "problem", "potential", "warning", "recommendation", "improvement", "suggestion", "action", "optimization", "performance", "refactor", "smell")
METADATA_KEYS = (
    "name", "object", "schema", "package", "procedure", "script", "type", "summary", "purpose", "signature", "column", "source_table", "select", "parameter", "input", "output", "entry", "status", "comment",
    "description", "grant", "target", "declared", "creation", "build", "parallel", "refresh", "constraint", "storage", "segment",
)


def consolidated_findings(summaries: DataFrame) -> DataFrame:
    """(script, section, place, detail, fields) of (script, summary): what stands under keys that hold findings, level by level.

    A list gives a finding for each object or text in it, an object one for each text, named by its key, and those of each list
    in it; a text is a finding itself. ``fields`` is the JSON of an object, whose own ``detail``, if any, is the detail.
    ``place`` orders a script's findings: places in the first and second level and in the list.

    Defined results: summaries that aren't JSON objects, or that have a key ``error``, have no findings; blank texts, numbers and
    nulls are none; keys are compared in lower case.
    """
    parsed = summaries.select("script", F.try_parse_json("summary").alias("summary"))
    parsed = parsed.where(F.schema_of_variant("summary").startswith("OBJECT") & ~F.array_contains(F.coalesce(F.json_object_keys(F.to_json("summary")), F.array().cast("array<string>")), "error"))
    key = F.lower("one_key")
    keys = exploded(parsed, "summary", "one").where(any_of([key.contains(k) for k in FINDING_KEYS]) & ~any_of([key.startswith(k) for k in METADATA_KEYS]))
    string = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    none = F.lit(None).cast("string")
    own = keys.select("script", F.col("one_key").alias("section"), F.array("one_pos").alias("place"), string("one").alias("detail"), none.alias("fields"))
    two = exploded(keys, "one", "two")
    named = F.concat("two_key", F.lit(": "), F.when(F.trim(F.regexp_replace(string("two"), r"\s", "")) != "", string("two")))
    named = two.where("one_is_object").select("script", F.col("one_key").alias("section"), F.array("one_pos", "two_pos").alias("place"), named.alias("detail"), none.alias("fields"))
    flat = two.where("one_is_array").select("script", F.col("one_key").alias("section"), F.array("one_pos", "two_pos").alias("place"), F.col("two").alias("item"), F.col("two_is_object").alias("is_object"))
    three = exploded(two.where("one_is_object and two_is_array"), "two", "three")
    deep = three.select("script", F.concat_ws(".", "one_key", "two_key").alias("section"), F.array("one_pos", "two_pos", "three_pos").alias("place"), F.col("three").alias("item"), F.col("three_is_object").alias("is_object"))
    items = flat.unionByName(deep)
    items = items.select("script", "section", "place", F.when(F.col("is_object"), F.try_variant_get("item", "$.detail", "string")).otherwise(string("item")).alias("detail"), F.when(F.col("is_object"), F.to_json("item")).alias("fields"))
    found = own.unionByName(named).unionByName(items)
    return found.where(F.col("fields").isNotNull() | (F.regexp_replace("detail", r"\s", "") != ""))
