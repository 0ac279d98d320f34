"""Running values along an order of any length without a task that holds the whole order.

A window over an unpartitioned table, or over one hot key, runs in a single task. Here the parts with too many rows, and only those, are cut into
blocks along the order, by rows and not by values; each block is windowed on its own, one summary row per block is carried forward, and the
carry is joined back. Where no part is too large, running values are plain windows over the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwright.session import stage

#: A part with at most so many rows is one window.
BLOCK_ROWS = 200_000
#: Blocks of a table at the most (beyond that they grow), which bounds the hot keys and the carries that are broadcast.
MOST_BLOCKS = 20_000


def blocked(df: DataFrame, part: list[str], order: list[str], name: str, rows: int = BLOCK_ROWS) -> tuple[DataFrame, str | None]:
    """df, read once and written to a stage, and the name of its column of blocks, None if no part has more than rows rows.

    The column, _blk, is -1 in parts that need no cutting; in others it doesn't fall along the order, and about rows rows share it. order holds
    column names without nulls; rows that are equal in part and order share a block.
    """
    d = stage(df, name)
    n = d.count()
    rows = max(rows, n // MOST_BLOCKS)
    if n <= rows:
        return d, None
    sizes = d.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    held = sizes.agg(F.sum("_n")).first()[0]
    if not held:
        return d, None
    large, small = d, None
    if part:
        keys = F.broadcast(sizes.select(*part))  # fewer than MOST_BLOCKS rows
        large, small = d.join(keys, part, "left_semi"), d.join(keys, part, "left_anti").withColumn("_blk", F.lit(-1))
    large = large.repartitionByRange(2 * -(-held // rows), *part, *order).withColumn("_blk", F.spark_partition_id())
    return stage(large if small is None else large.unionByName(small), name), "_blk"


def running(df: DataFrame, part: list[str], block: str | None, order: list[str], value: Column | dict[str, Column], how: str, name: str = "", inclusive: bool = False, reverse: bool = False) -> DataFrame:
    """Add name: 'max', 'sum' or 'last' (non-null) of value over the rows before each row of its part, in the given order.

    order holds column names without nulls that order the rows totally; block (see blocked) must not fall along it. With inclusive the row itself
    counts; with reverse the rows after it are taken. Parts and blocks must not be null. No earlier value: null, or 0 for a sum. A dictionary of
    names and values adds several columns at once. With blocks, df is read once: rows and local values are staged before they are summed up.
    """
    if how not in ("max", "sum", "last"):
        raise ValueError(how)
    values = value if isinstance(value, dict) else {name: value}
    keys = [*part, *([block] if block else [])]
    by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    so_far = {n: F.last(v, ignorenulls=True).over(w) if how == "last" else (F.max if how == "max" else F.sum)(v).over(w) for n, v in values.items()}
    if block is None:
        return df.withColumns({n: F.coalesce(c, F.lit(0)) if how == "sum" else c for n, c in so_far.items()})
    local = df.withColumns({**{f"_local_{n}": c for n, c in so_far.items()}, **{f"_value_{n}": v for n, v in values.items()}})
    local = stage(local, "running")
    b = F.col(block).desc() if reverse else F.col(block).asc()
    wb = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    of_block, carry = [], {}
    for n in values:
        v = F.col(f"_value_{n}")
        if how == "last":
            at = F.struct(*[F.col(c) for c in order], v.alias("_v"))
            of_block.append((F.min if reverse else F.max)(F.when(v.isNotNull(), at))["_v"].alias(f"_of_{n}"))
            carry[f"_carry_{n}"] = F.last(f"_of_{n}", ignorenulls=True).over(wb)
        else:
            f = F.max if how == "max" else F.sum
            of_block.append(f(v).alias(f"_of_{n}"))
            carry[f"_carry_{n}"] = f(f"_of_{n}").over(wb)
    carries = local.where(F.col(block) >= 0).groupBy(*keys).agg(*of_block).withColumns(carry).select(*keys, *carry)
    out = local.join(F.broadcast(carries), keys, "left")  # a row per block and part that reaches into it: at most a few times MOST_BLOCKS
    for n in values:
        a, c = F.col(f"_local_{n}"), F.col(f"_carry_{n}")
        both = {"max": F.greatest(a, c), "last": F.coalesce(a, c), "sum": F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0))}[how]
        out = out.withColumn(n, both).drop(f"_local_{n}", f"_carry_{n}", f"_value_{n}")
    return out


def fill_ordered(df: DataFrame, ordinal: str, value: str, name: str, group: str | None = None, forward: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward or backward fill of value along ordinal (a non-null whole number), over the whole table or within group.

    Rows whose group is null form no group and keep their value. Ties in ordinal must not occur.
    """
    part = [] if group is None else ["_g"]
    d = df if group is None else df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\u0000"), F.col(ordinal).cast("string"))))
    d, b = blocked(d, part, [ordinal], "fill", block_rows)
    return running(d, part, b, [ordinal], F.col(value), "last", name, inclusive=True, reverse=not forward).drop("_blk", "_g")


def position(df: DataFrame, part: list[str], block: str | None, order: list[str], name: str) -> DataFrame:
    """Add name: how many rows of the part come before, as row_number() - 1 does within one task."""
    return running(df, part, block, order, F.lit(1).cast("bigint"), "sum", name)


def place(df: DataFrame, part: list[str], order: list[str], name: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """position(), with blocks of its own."""
    d, b = blocked(df, part, order, "place", rows)
    return position(d, part, b, order, name).drop("_blk")
