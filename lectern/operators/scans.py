"""Running sums, minima and maxima along a key's rows, in blocks: a hot key spreads over tasks.

Rows are sorted by ranges of key and order, so that a key with many rows takes several blocks. A window runs
within each (key, block); the blocks' totals, of which a key has at most as many as there are ranges, run
in a window of their own; what comes before a block is joined to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.folds import cut

BLOCK = "_block"
_JOINED = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def in_blocks(rows: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """`rows` with a column _block: ranges of (keys, order) that follow one another, as a checkpoint.

    Rows with one key and place are in one block, so `order` should tell a key's rows apart. Nulls come first.
    """
    by = [*keys, *order]
    ranges = rows.repartitionByRange(blocks, *by) if blocks else rows.repartitionByRange(*by)
    return cut(ranges.withColumn(BLOCK, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], **columns: tuple[str, Column, object]) -> DataFrame:
    """`rows` of `in_blocks` with more columns: each is (sum | min | max, what, value before the first) up to and with the row."""
    own = {name: getattr(F, kind)(what) for name, (kind, what, _) in columns.items()}
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, BLOCK).agg(*[x.alias(name) for name, x in own.items()])
    carried = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(BLOCK).alias("_of"), *[getattr(F, kind)(name).over(before).alias(f"_{name}") for name, (kind, _, _) in columns.items()])
    same = F.col(BLOCK) == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    local = rows.select("*", *[x.over(inside).alias(name) for name, x in own.items()])
    out = local.join(carried, same)

    def both(name: str) -> Column:
        kind, _, first = columns[name]
        zero = F.lit(first)
        return _JOINED[kind](F.coalesce(F.col(name), zero), F.coalesce(F.col(f"_{name}"), zero))

    return out.select(*[c for c in rows.columns if c not in columns], *[both(name).alias(name) for name in columns])
