"""Running values over the earlier rows of a key, for keys of any size.

A window over a key puts all its rows into one task. Here a key's rows are cut
into blocks of the order column; windows run within blocks, each block is summed
up, and what came before a block is carried in by a window over the blocks,
which are fewer by the block's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the order column that one block spans.
BLOCK = 1 << 16

#: How values of earlier rows become one, and two of those one.
SUM, ANY, LAST = "sum", "any", "last"


def running(rows: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """``rows`` with one column per value, taken over the rows of the key that are strictly before in ``order`` (a whole number).

    Kinds: SUM (0 if none), ANY of some booleans (false if none), LAST non-null
    value (null if none; of rows equal in order the greatest).
    """
    names = list(values)
    marked = rows.withColumns({"__block": F.floor(F.col(order) / block), **{f"__v{i}": v for i, (_, v) in enumerate(values.values())}})
    by = [*keys, "__block"]
    before = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    over_blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    kinds = [kind for kind, _ in values.values()]
    whole = lambda kind, c: F.sum(c) if kind == SUM else F.max(c) if kind == ANY else F.max(F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), c.alias("v"))))
    totals = marked.groupBy(*by).agg(*[whole(k, F.col(f"__v{i}")).alias(f"__t{i}") for i, k in enumerate(kinds)])
    join = lambda kind, c: F.sum(c) if kind == SUM else F.max(c)  # later blocks have the greater order
    carried = totals.select(*by, *[join(k, F.col(f"__t{i}")).over(over_blocks).alias(f"__c{i}") for i, k in enumerate(kinds)])
    local = marked.select("*", *[whole(k, F.col(f"__v{i}")).over(before).alias(f"__l{i}") for i, k in enumerate(kinds)])
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    both = local.alias("l").join(carried.alias("c"), same)

    def combined(i: int, kind: str) -> Column:
        here, there = F.col(f"l.__l{i}"), F.col(f"c.__c{i}")
        if kind == SUM:
            return F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        if kind == ANY:
            return F.coalesce(here, F.lit(False)) | F.coalesce(there, F.lit(False))
        return F.coalesce(here["v"], there["v"])

    return both.select(*[F.col(f"l.{c}") for c in rows.columns], *[combined(i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])
