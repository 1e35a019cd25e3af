"""Names that are told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_names(rows: DataFrame, key: str, base: str) -> DataFrame:
    """(key, name): the first of equal names, by key, keeps it, the next get `_2`, `_3` and so on, but no suffix that makes another row's own name.

    A suffixed name can only be another base, or made from the same base, so the names are distinct. Suffixes that are taken are looked up by
    base, of nine digits at most, as no base has more rows than those.
    """
    numbered = rows.select(key, base, F.row_number().over(Window.partitionBy(base).orderBy(key)).alias("_n"))
    parts = r"^(.*)_([1-9][0-9]{0,8})$"
    own = rows.select(base).distinct().where(F.col(base).rlike(parts))
    taken = own.groupBy(F.regexp_extract(base, parts, 1).alias("_base")).agg(F.collect_set(F.regexp_extract(base, parts, 2).cast("int")).alias("_taken"))
    met = numbered.join(taken, numbered[base] == taken["_base"], "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(2), F.col("_n") + F.size("_taken") + 1), "_taken")
    return met.select(key, F.concat(base, F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit("_"), F.get(free, F.col("_n") - 2).cast("string")))).alias("name"))
