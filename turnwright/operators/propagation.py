"""Filling missing values from similar records by label propagation.

Rows are the nodes of a graph. Edges join a row to the few rows before and after it in the order of logging, to the nearest row on each side
that has a group, and to the nearest rows of its group that have a number; they weigh more the closer two rows are in time and the better their
places in the group follow each other. Observed values are clamped; a missing number becomes the weighted average of what its neighbours imply,
a missing category takes the distribution of its neighbours, again and again until no share and no number moves by more than a tolerance. Rows
that no chain of edges reaches take the average of their group, else of their time, else of all.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwright.operators.skew import salted_join
from turnwright.session import drop_stage, stage

#: Rows in whose order neighbours are sought at once.
BLOCK = 8192
#: Values have settled when no share moves by more than the first in a round, and no number by more than the second.
SHARE_TOLERANCE, NUMBER_TOLERANCE = 1e-3, 1e-2


def ranked(df: DataFrame, key: str, time: str, group: str, number: str, ordinal: str) -> DataFrame:
    """Rows (i, ts, g, x, o, r) with a key, each key once, and their rank r from 0 in the order of the key, however the keys are spaced."""
    d = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("i"), F.col(time).cast("timestamp").cast("double").alias("ts"), F.col(group).cast("string").alias("g"), F.col(number).cast("double").alias("x"), F.col(ordinal).cast("bigint").alias("o")
    )
    d = d.dropDuplicates(["i"]).repartitionByRange("i").sortWithinPartitions("i").withColumn("_m", F.monotonically_increasing_id())
    d = stage(d, "p1-rows").withColumn("_p", F.shiftright("_m", 33))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition of the order
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(sizes), "_p").withColumn("r", F.col("_before") + F.col("_m") - F.shiftleft("_p", 33)).select("i", "ts", "g", "x", "o", "r")


def neighbourhoods(d: DataFrame, each_side: int = 3) -> DataFrame:
    """Of ranked rows the nodes that lack their group or number: (i, ts, g, x, o, r, near) with near the observed state of their neighbours, each once.

    Blocks of ranks overlap by each_side, so a block holds all neighbours by rank of its own rows. The nearest rows with a group, and of the same
    group with a number, are sought within the block; what lies beyond is reached over several edges.
    """
    own, at = F.floor(F.col("r") / BLOCK), F.pmod(F.col("r"), F.lit(BLOCK))
    blocks = F.array_compact(F.array(own, F.when(at < each_side, own - 1), F.when(at >= BLOCK - each_side, own + 1)))
    d = d.withColumn("b", F.explode(blocks)).repartition("b")
    w = Window.partitionBy("b").orderBy("r")
    # a frame up to the end of the block would be summed up anew for each row, one from its beginning isn't: behind is before in falling order
    before = lambda by, *part: Window.partitionBy("b", *part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    asc, desc = F.asc("r"), F.desc("r")
    node = F.struct(F.col("i").alias("j"), "ts", "g", "x", "o", "r")
    near = {f"_{f.__name__}{k}": f(node, k).over(w) for k in range(1, each_side + 1) for f in (F.lag, F.lead)}
    known, same = F.when(F.col("g").isNotNull(), node), F.when(F.col("g").isNotNull() & F.col("x").isNotNull(), node)
    near |= {"_known_before": F.last(known, ignorenulls=True).over(before(asc)), "_known_behind": F.last(known, ignorenulls=True).over(before(desc))}
    d = d.withColumns(near)
    near_group = {"_same_before": F.last(same, ignorenulls=True).over(before(asc, "g")), "_same_behind": F.last(same, ignorenulls=True).over(before(desc, "g"))}
    d = d.withColumns(near_group).where((F.col("b") == own) & (F.col("g").isNull() | F.col("x").isNull()))
    return d.select("i", "ts", "g", "x", "o", "r", F.array_distinct(F.array_compact(F.array(*near, *near_group))).alias("near"))


def _closeness(scale: float) -> Column:
    gap = F.abs(F.col("ts") - F.col("n.ts"))
    return F.coalesce(scale / (scale + gap), F.lit(0.01))


def propagate(df: DataFrame, key: str, time: str, group: str, number: str, ordinal: str, rounds: int = 4, most_rounds: int = 200) -> DataFrame:
    """Fills (key, field_name, text_value, number_value, confidence, source) for each row that lacks its group or number.

    df: key a whole number in the order of logging, time a timestamp, group a category, number a quantity above zero that grows with time
    within the group, ordinal the place in the group; null means missing. source is 'neighbours', 'group', 'time', 'all' or, where the whole
    table holds no value to take, 'none' with null values. Values that haven't settled after most_rounds are taken with a warning. Rows without a key can't be named in the result and are left out. Repeated keys
    count once. An empty table gives no fills.
    """
    base = ranked(df, key, time, group, number, ordinal)
    nodes = stage(neighbourhoods(base), "p1-nodes")
    groups = stage(_categories(nodes, rounds, most_rounds), "p1-groups")
    numbers = stage(_numbers(nodes, groups, rounds, most_rounds), "p1-numbers")
    g_open, x_open = groups.where("g is null").limit(1).count(), numbers.where("x is null").limit(1).count()
    if g_open:
        groups = _fall_back_groups(groups, base)
    else:
        groups = groups.withColumn("source", F.lit("neighbours"))
    if x_open:
        numbers = _fall_back_numbers(numbers, groups, base)
    else:
        numbers = numbers.withColumn("source", F.lit("neighbours"))
    a = groups.select(F.col("i").alias(key), F.lit(group).alias("field_name"), F.col("g").alias("text_value"), F.lit(None).cast("double").alias("number_value"), F.col("p").alias("confidence"), "source")
    b = numbers.select(F.col("i").alias(key), F.lit(number).alias("field_name"), F.lit(None).cast("string").alias("text_value"), F.col("x").alias("number_value"), F.lit(None).cast("double").alias("confidence"), "source")
    return a.unionByName(b)


def _categories(nodes: DataFrame, rounds: int, most_rounds: int) -> DataFrame:
    """(i, ts, g, p): the category of highest mass of each node without one; null where no edge leads to an observed row."""
    lost = nodes.where("g is null")
    follows = F.when(F.col("n.o") - F.col("o") == F.col("n.r") - F.col("r"), 8.0).otherwise(1.0)
    same_start = F.when(F.abs((F.col("n.x") - F.col("x")) - (F.col("n.ts") - F.col("ts"))) < 2.0, 8.0).otherwise(1.0)
    e = lost.withColumn("n", F.explode("near")).select("i", F.col("n.j").alias("j"), F.col("n.g").alias("g"), (_closeness(30.0) * follows * same_start).alias("w"))
    seen = e.where("g is not null").groupBy("i", "g").agg(F.sum("w").alias("m"))
    links = e.where("g is null").select("i", "j", "w")
    if not links.limit(1).count():
        mass = _shares(seen)
    else:
        seen, links = stage(seen, "p1-seen"), stage(links, "p1-links")
        mass = _settle(_shares(seen), lambda m: _shares(seen.unionByName(_told(links, m)).groupBy("i", "g").agg(F.sum("m").alias("m"))), ["i", "g"], "p", SHARE_TOLERANCE, rounds, most_rounds)
    best = mass.groupBy("i").agg(F.max(F.struct("p", "g")).alias("b")).select("i", "b.g", "b.p")
    return lost.select("i", "ts").join(best, "i", "left")


def _told(links: DataFrame, mass: DataFrame) -> DataFrame:
    return links.join(mass.withColumnRenamed("i", "j"), "j").groupBy("i", "g").agg(F.sum(F.col("w") * F.col("p")).alias("m"))


def _settle(state: DataFrame, step, keys: list[str], value: str, tolerance: float, rounds: int, most_rounds: int) -> DataFrame:
    """state after as many steps as it takes until none of its values moves by more than tolerance and no new ones come; stages every rounds."""
    for done in range(rounds, most_rounds + rounds, rounds):
        old = state
        for _ in range(rounds):
            before, state = state, step(state)
        moved = F.abs(F.coalesce(F.col(value), F.lit(0.0)) - F.coalesce(F.col("_was"), F.lit(0.0)))
        both = stage(state.join(before.withColumnRenamed(value, "_was"), keys, "full").withColumn("_moved", F.when(F.col("_was").isNull(), F.lit(float("inf"))).otherwise(moved)), "p1-state")
        if done > rounds:
            drop_stage(old)
        state = both.where(F.col(value).isNotNull()).select(*keys, value)
        if (both.agg(F.max("_moved")).first()[0] or 0.0) <= tolerance:
            return state
    warnings.warn(f"values haven't settled in {most_rounds} rounds", stacklevel=2)
    return state


def _shares(mass: DataFrame) -> DataFrame:
    return mass.select("i", "g", (F.col("m") / F.sum("m").over(Window.partitionBy("i"))).alias("p"))


def _numbers(nodes: DataFrame, groups: DataFrame, rounds: int, most_rounds: int) -> DataFrame:
    """(i, ts, g, x) of each node without a number: averages over neighbours of the same group, shifted by the time between the two rows."""
    filled = groups.where("g is not null").select(F.col("i").alias("k"), F.col("g").alias("h"))
    lost = nodes.where("x is null").join(filled, F.col("i") == F.col("k"), "left").withColumn("g", F.coalesce("g", "h")).drop("h", "k")
    e = lost.select("i", "ts", "g", "o", F.explode("near").alias("n"))
    e = e.join(filled, F.col("n.j") == F.col("k"), "left").withColumn("ng", F.coalesce("n.g", "h")).where("g = ng")
    step = F.coalesce(F.col("ts") - F.col("n.ts"), F.lit(0.0))
    e = e.select("i", F.col("n.j").alias("j"), F.col("n.x").alias("x"), step.alias("d"), _closeness(10.0).alias("w"))
    seen = e.where("x is not null").groupBy("i").agg(F.sum(F.col("w") * (F.col("x") + F.col("d"))).alias("a"), F.sum("w").alias("n"))
    links = e.where("x is null").select("i", "j", "d", "w")
    x = seen.select("i", (F.col("a") / F.col("n")).alias("x"))
    if links.limit(1).count():
        seen, links = stage(seen, "p1-nseen"), stage(links, "p1-nlinks")

        def step(x: DataFrame) -> DataFrame:
            told = links.join(x.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("w") * (F.col("x") + F.col("d"))).alias("a"), F.sum("w").alias("n"))
            return seen.unionByName(told).groupBy("i").agg((F.sum("a") / F.sum("n")).alias("x"))

        x = _settle(seen.select("i", (F.col("a") / F.col("n")).alias("x")), step, ["i"], "x", NUMBER_TOLERANCE, rounds, most_rounds)
    return lost.select("i", "ts", "g").join(x, "i", "left").withColumn("x", F.when(F.col("x").isNotNull(), F.greatest("x", F.lit(0.01))))


def _fall_back_groups(groups: DataFrame, base: DataFrame) -> DataFrame:
    """The commonest category of the same hour, else of all rows."""
    hour = F.floor(F.col("ts") / 3600)
    n = base.where("g is not null").withColumn("hour", hour).groupBy("hour", "g").count()
    top = n.groupBy("hour").agg(F.max(F.struct("count", "g"))["g"].alias("g_hour"))
    whole = n.groupBy("g").agg(F.sum("count").alias("c")).agg(F.max(F.struct("c", "g"))["g"]).first()[0]  # one value
    d = groups.withColumn("hour", F.floor(F.col("ts") / 3600)).join(top, "hour", "left").withColumn("g_all", F.lit(whole).cast("string"))
    source = F.when(F.col("g").isNotNull(), "neighbours").when(F.col("g_hour").isNotNull(), "time").when(F.col("g_all").isNotNull(), "all").otherwise("none")
    return d.select("i", "ts", F.coalesce("g", "g_hour", "g_all").alias("g"), "p", source.alias("source"))


def _fall_back_numbers(numbers: DataFrame, groups: DataFrame, base: DataFrame) -> DataFrame:
    """The average of the same group, else of the same hour, else of all rows."""
    g = groups.select(F.col("i").alias("k"), F.col("g").alias("h"))
    d = numbers.join(g, F.col("i") == F.col("k"), "left").withColumn("g", F.coalesce("g", "h")).drop("h", "k").withColumn("hour", F.floor(F.col("ts") / 3600))
    seen = base.where("x is not null")
    by_group = seen.where("g is not null").groupBy("g").agg(F.avg("x").alias("x_group"))
    by_hour = seen.groupBy(F.floor(F.col("ts") / 3600).alias("hour")).agg(F.avg("x").alias("x_hour"))
    whole = seen.agg(F.avg("x")).first()[0]  # one value
    d = salted_join(stage(d, "p1-open"), by_group, "g", "left")
    d = d.join(by_hour, "hour", "left").withColumn("x_all", F.lit(whole).cast("double"))
    source = F.when(F.col("x").isNotNull(), "neighbours").when(F.col("x_group").isNotNull(), "group").when(F.col("x_hour").isNotNull(), "time").when(F.col("x_all").isNotNull(), "all").otherwise("none")
    return d.select("i", "ts", F.coalesce("x", "x_group", "x_hour", "x_all").alias("x"), source.alias("source"))


def apply_fills(df: DataFrame, fills: DataFrame, key: str, group: str, number: str) -> DataFrame:
    """df with group and number filled and two columns <name>_filled that mark the fills. Rows without a key pass unfilled."""
    wide = fills.groupBy(key).agg(
        F.max(F.when(F.col("field_name") == group, F.col("text_value"))).alias("_g"),
        F.max(F.when(F.col("field_name") == number, F.col("number_value"))).alias("_x"),
        F.max(F.col("field_name") == group).alias("_gf"),
        F.max(F.col("field_name") == number).alias("_xf"),
    )
    out = df.join(wide, key, "left")
    out = out.withColumns({group: F.coalesce(F.col(group), F.col("_g")), number: F.coalesce(F.col(number), F.col("_x")), f"{group}_filled": F.coalesce("_gf", F.lit(False)), f"{number}_filled": F.coalesce("_xf", F.lit(False))})
    return out.drop("_g", "_x", "_gf", "_xf")

