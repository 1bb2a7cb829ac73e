"""Running values in two levels, for keys that may hold a large share of all rows.

A window over a key sorts all of its rows in one task. Here the rows of a key are
cut into blocks; each block is summed up in one row (partial aggregation, so the
exchange carries a row a block and task), a window over the few rows of a key gives
what came before each block, and a window over (key, block) does the rest. So a key
of any size is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.column import Column


def _summed(kind: str, value: Column, order: list[Column]) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "count": F.count}[kind](value)


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "count": F.sum}[kind](value).over(window)


def running(rows: DataFrame, key: str, block: Column, order: list, **values: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``values`` (name = (kind, expression)): its running sum, count, max or last value that isn't null, up to and with each row.

    ``block`` must not fall along ``order``, which orders the rows of a key and has no
    ties that matter. ``rows`` is read twice, so it had better be a table.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    cut = rows.withColumn("__block", block)
    sums = cut.groupBy(key, "__block").agg(*[_summed(k, v, order).alias(f"__was_{n}") for n, (k, v) in values.items()])
    earlier = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col(key).alias("__key"), F.col("__block").alias("__in"), *[_over(k, F.col(f"__was_{n}"), earlier).alias(f"__was_{n}") for n, (k, _) in values.items()])
    joined = cut.join(before.hint("merge"), cut[key].eqNullSafe(before["__key"]) & (cut["__block"] == before["__in"]))
    own = W.partitionBy(key, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)

    def whole(name: str, kind: str, value: Column) -> Column:
        here, carried = _over(kind, F.when(value.isNotNull(), 1).otherwise(0) if kind == "count" else value, own), F.col(f"__was_{name}")
        if kind in ("sum", "count"):
            return F.coalesce(carried + here, carried, here)
        return F.greatest(carried, here) if kind == "max" else F.coalesce(here, carried)

    return joined.select(*rows.columns, *[whole(n, k, v).alias(n) for n, (k, v) in values.items()])
