"""Groups of rows that depend on each other through either of two keys.

Rows that share a left or a right key belong together. Labels travel along the
distinct pairs of keys for a bounded number of rounds. A label whose left keys
have no other label is a group of its own, whatever the rest does. Keys are
compared by a hash; groups that a collision merges are one larger group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.session import cut_lineage

#: Rounds of labels, each over both keys, and rows of the largest group.
ROUNDS = 6
GROUP_ROWS = 1 << 16


def linked_groups(rows: DataFrame, left: str, right: str, linking: Column, rounds: int = ROUNDS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of known groups of at most ``group_rows`` rows, with their ``group``; and all others, None if there are none.

    Rows that are not ``linking`` go with their left key only. No row depends on
    one of another group, nor on one of the other table.
    """
    spark = rows.sparkSession

    def least(pairs: DataFrame, side: str) -> DataFrame:
        found = pairs.groupBy(side).agg(F.min("label").alias("label"))
        return pairs.drop("label").join(found, side).select("a", "b", "label")

    pairs = rows.where(linking).select(F.xxhash64(left).alias("a"), F.xxhash64(right).alias("b")).distinct()
    pairs = pairs.withColumn("label", F.col("b"))
    for _ in range(rounds):
        pairs = cut_lineage(spark, least(least(pairs, "a"), "b"), "pairs")
        sides = pairs.groupBy("a").agg(F.min("label").alias("group"), F.max("label").alias("other"))
        if sides.where(F.col("group") != F.col("other")).isEmpty():
            break
    # without a pair a left key is its own group
    labelled = rows.withColumn("a", F.xxhash64(left)).join(sides.select("a", "group"), "a", "left").withColumn("group", F.coalesce("group", "a")).drop("a")
    labelled = cut_lineage(spark, labelled, "groups")
    mixed = sides.where(F.col("group") != F.col("other")).select("a")
    loose = pairs.join(mixed, "a", "left_semi").select(F.col("label").alias("group"))
    large = labelled.groupBy("group").count().where(F.col("count") > group_rows).select("group")
    others = cut_lineage(spark, loose.unionByName(large).distinct(), "loose")
    if others.isEmpty():
        return labelled, None
    return labelled.join(others, "group", "left_anti"), labelled.join(others, "group", "left_semi").drop("group")
