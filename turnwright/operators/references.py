"""References to records that do not exist: signed counts of references and of existence, kept from change deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.operators.ordered import BLOCK_ROWS, blocked, running


def existence_deltas(register: DataFrame, key: str, born: str, died: str) -> DataFrame:
    """Change deltas (key, at, d_exist, d_ever) of a register whose entries exist from born until before died (null: still).

    Each entry adds one at its birth and takes one at its death; an entry that dies before or when it is born never exists but counts in d_ever.
    Entries without a key are left out; entries without a birth are known but never exist (at is null). Repeated entries add and take the same
    number, so counts stay positive exactly while some entry exists.
    """
    lives = F.col(died).isNull() | (F.col(died) > F.col(born))
    changes = F.array(
        F.struct(F.col(born).alias("at"), F.when(lives & F.col(born).isNotNull(), 1).otherwise(0).alias("d_exist"), F.when(F.col(born).isNotNull(), 1).otherwise(0).alias("d_ever")),
        F.when(lives & F.col(died).isNotNull() & F.col(born).isNotNull(), F.struct(F.col(died).alias("at"), F.lit(-1).alias("d_exist"), F.lit(0).alias("d_ever"))),
    )
    d = register.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(changes).alias("c")).where("c is not null")
    return d.select("key", "c.*")


def orphans(references: DataFrame, register: DataFrame, key: str, at: str, register_key: str, born: str, died: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The references, plus orphan_kind, whose key doesn't exist at their time.

    The state of each key is kept through time as signed counts: a reference adds one to n_ref when it comes, changes of the register add and take
    from n_exist (see existence_deltas). References that come to a state with n_ref > 0 and n_exist <= 0 are orphans: 'missing' if the register
    never names the key, 'deleted' if an entry was born by then, else 'late'. Counts are running sums over the deltas of a key in order of time,
    with carried sums where a key has more than block_rows, so a key that holds a third of all references, or of the register, is in no single
    task; nothing is broadcast. Rows without a key are no references. A reference without a time is an orphan only if its key is missing. Repeated
    references come out as often as they went in. All columns of references are kept; names beginning with an underscore and orphan_kind are
    reserved.
    """
    none = F.lit(0).cast("bigint")
    refs = references.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.struct(*[F.col(f"`{c}`") for c in references.columns]).alias("_row"))
    changes = existence_deltas(register, register_key, born, died).where("at is not null").groupBy("key", F.col("at").cast("timestamp").alias("at")).agg(F.sum("d_exist").alias("d_exist"), F.sum("d_ever").alias("d_ever"))
    named = register.where(F.col(register_key).isNotNull()).select(F.col(register_key).alias("key")).distinct()
    row = F.lit(None).cast(refs.schema["_row"].dataType).alias("_row")
    # of one instant, and so of all without a time, the name comes first, then changes of the register, then references
    deltas = named.select("key", F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("_turn"), none.alias("d_ref"), none.alias("d_exist"), none.alias("d_ever"), F.lit(1).cast("bigint").alias("d_named"), row)
    deltas = deltas.unionByName(changes.select("key", "at", F.lit(1).alias("_turn"), none.alias("d_ref"), "d_exist", "d_ever", none.alias("d_named"), row))
    deltas = deltas.unionByName(refs.select("key", "at", F.lit(2).alias("_turn"), F.lit(1).cast("bigint").alias("d_ref"), none.alias("d_exist"), none.alias("d_ever"), none.alias("d_named"), "_row"))
    deltas = deltas.withColumn("_us", F.coalesce(F.unix_micros("at"), F.lit(-(2**63)).cast("bigint")))
    deltas, b = blocked(deltas, ["key"], ["_us", "_turn"], "p5-deltas", block_rows)
    state = running(deltas, ["key"], b, ["_us", "_turn"], {f"n_{x}": F.col(f"d_{x}") for x in ("ref", "exist", "ever", "named")}, "sum", inclusive=True)
    late = F.when(F.col("at").isNotNull(), F.when(F.col("n_ever") > 0, "deleted").otherwise("late"))
    kind = F.when(F.col("n_named") == 0, "missing").otherwise(late)
    return current_orphans(state.where("_turn = 2")).select("_row.*", kind.alias("orphan_kind")).where("orphan_kind is not null")


def reference_deltas(references: DataFrame, key: str, sign: int = 1) -> DataFrame:
    """Signed reference counts per key of a batch of changes: +1 for rows that came, -1 for rows that went."""
    return references.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.count(F.lit(1)) * sign).alias("d_ref")).withColumn("d_exist", F.lit(0).cast("bigint"))


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """State (key, n_ref, n_exist) after further deltas (key, d_ref, d_exist). Keys whose counts are both zero leave the state."""
    parts = [x.select("key", F.col("d_ref").cast("bigint").alias("n_ref"), F.col("d_exist").cast("bigint").alias("n_exist")) for x in deltas]
    if state is not None:
        parts.append(state.select("key", "n_ref", "n_exist"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("key").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_exist").alias("n_exist")).where("n_ref != 0 or n_exist != 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return state.where("n_ref > 0 and n_exist <= 0")


def orphan_report(found: DataFrame, table: str, at: str, period: str = "day") -> DataFrame:
    """Orphans counted per table, period of their time, and kind."""
    return found.groupBy(F.col(table).alias("table_name"), F.date_trunc(period, at).alias("period"), "orphan_kind").agg(F.count(F.lit(1)).alias("n_orphans"))
