"""Free-form JSON as variants, taken apart level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, column: str, to: str) -> DataFrame:
    """A row for each element of an array or object in the variant ``column``, which it replaces.

    Adds ``to`` (the element), ``to``_key (its key, null in arrays), ``to``_pos, and ``to``_is_array and ``to``_is_object, which tell what
    the element is. Scalars, nulls and empty ones have no rows.
    """
    spark = rows.sparkSession
    parts = spark.tvf.variant_explode(F.col(column).outer())
    kind = F.schema_of_variant("value")
    joined = rows.lateralJoin(parts).drop(column)
    kept = [c for c in rows.columns if c != column]
    return joined.select(*kept, F.col("value").alias(to), F.col("key").alias(f"{to}_key"), F.col("pos").alias(f"{to}_pos"), kind.startswith("ARRAY").alias(f"{to}_is_array"), kind.startswith("OBJECT").alias(f"{to}_is_object"))
