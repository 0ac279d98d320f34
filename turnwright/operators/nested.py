"""Deeply nested records as related flat tables, with identical objects stored once (Merkle subtree identities)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.functions.parses import dumps, identify, read
from turnwright.operators.skew import salted_join
from turnwright.session import drop_stage, stage

#: Levels that occurrences() goes down before it starts anew from objects whose places it already knows.
LEVELS = 64
#: Texts and objects that a worker remembers so as not to hash or send them again; forgetting only costs time.
REMEMBERED = 50_000
MOST_SENT = 200_000

_CHILD = "struct<hash: binary, name: string, leaf: boolean, place: int>"
_ROWS = f"row_id bigint, hash binary, name string, value string, conf double, height int, level int, children array<{_CHILD}>"
_KINDS = {"row_id": pa.int64(), "hash": pa.binary(), "name": pa.string(), "value": pa.string(), "conf": pa.float64(), "height": pa.int32(), "level": pa.int32()}
_CHILD_KINDS = {"hash": pa.binary(), "name": pa.string(), "leaf": pa.bool_(), "place": pa.int32()}


def _batch(rows: list[tuple], children: list[tuple], ends: list[int]) -> pa.RecordBatch:
    cols = [pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(_KINDS), _KINDS.values(), strict=True)]
    kids = [pa.array(x, type=k) for x, k in zip(zip(*children, strict=True) if children else [()] * len(_CHILD_KINDS), _CHILD_KINDS.values(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.StructArray.from_arrays(kids, names=list(_CHILD_KINDS)))
    return pa.RecordBatch.from_arrays([*cols, lists], names=[*_KINDS, "children"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (row_id, hash) for each text with nodes, and the objects, on each level where they occur, that this task hasn't sent yet.
    Whole records lie on level 0 and their top nodes on level 1, level 1 again comes behind level LEVELS; level -1 holds, for records that reach deeper than LEVELS, the whole record
    with the inner nodes of each LEVELS-th level as children, placed by their numbers."""
    texts: dict[str, bytes] = {}
    seen: set[tuple[bytes, int]] = set()
    for batch in batches:
        rows: list[tuple] = []
        children: list[tuple] = []
        ends = [0]
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole = texts.get(text)
            if whole is None:
                nodes = read(text)
                if not nodes:
                    continue
                ids, height, whole = identify(nodes)
                if (whole, 0) not in seen:
                    seen.add((whole, 0))
                    depth = [1] * len(nodes)
                    roots = []
                    for i, x in enumerate(nodes):
                        if x.parent < 0:
                            roots.append(i)
                        else:
                            depth[i] = depth[x.parent] + 1
                    children += [(ids[k], nodes[k].name, not nodes[k].kids, k + 1) for k in roots]
                    rows.append((None, whole, None, None, None, 1 + max(height[i] for i in roots), 0))
                    ends.append(len(children))
                    for i, x in enumerate(nodes):
                        at = ids[i], (depth[i] - 1) % LEVELS + 1 if x.kids else 1  # leaves aren't looked up: one level does
                        if at not in seen:
                            seen.add(at)
                            v = x.value if x.value is None or isinstance(x.value, str) else dumps(x.value)
                            children += [(ids[k], nodes[k].name, not nodes[k].kids, k - i) for k in x.kids]
                            rows.append((None, ids[i], x.name, v, float(x.conf) if isinstance(x.conf, (int, float)) else None, height[i], at[1]))
                            ends.append(len(children))
                    entries = [i for i, x in enumerate(nodes) if depth[i] % LEVELS == 0 and x.kids]
                    if entries:
                        children += [(ids[k], nodes[k].name, False, k + 1) for k in entries]
                        rows.append((None, whole, None, None, None, None, -1))
                        ends.append(len(children))
                if len(texts) >= REMEMBERED:
                    texts.clear()
                if len(seen) >= 8 * REMEMBERED:
                    seen.clear()
                if len(text) < 4096:
                    texts[text] = whole
            rows.append((row_id, whole, None, None, None, None, None))
            ends.append(len(children))
            if len(children) > MOST_SENT:  # very large records: don't let a batch grow with them
                yield _batch(rows, children, ends)
                rows, children, ends = [], [], [0]
        yield _batch(rows, children, ends)


class NestedTables:
    """The flat tables of a column of nested records.

    rows: (row_id, hash), a row's whole record. objects: (hash, name, value, conf, height, children), each distinct object once; a whole record
    has no name. bridge: (parent_hash, ordinal, child_hash, child_name, place): the children of an object in order; place is the distance of
    the child from its parent in the order written.
    """

    def __init__(self, df: DataFrame, key: str, text: str):
        """df: one text per key (a whole number); repeated keys count once. Null and empty texts, stand-ins and unreadable JSON have no nodes."""
        d = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("text")).where("row_id is not null and text is not null")
        both = stage(d.mapInArrow(_objects, _ROWS), "p4-objects")
        self.rows = both.where("row_id is not null").select("row_id", "hash").dropDuplicates(["row_id"])
        self.objects = both.where("row_id is null and level >= 0").drop("row_id", "level").dropDuplicates(["hash"])
        self._both = both

    @property
    def bridge(self) -> DataFrame:
        return self.objects.select(F.col("hash").alias("parent_hash"), F.posexplode("children").alias("n", "c")).select(
            "parent_hash", (F.col("n") + 1).alias("ordinal"), F.col("c.hash").alias("child_hash"), F.col("c.name").alias("child_name"), F.col("c.place").alias("place")
        )

    def occurrences(self, last_use: bool = False) -> DataFrame:
        """(row_id, node_no, parent_no, node_name) of every node of every row, read back from the distinct objects through the bridge.

        Level by level the children of the distinct whole records are looked up among the objects of that level, and each level is staged before
        the next, so work grows with nodes and not with levels times nodes; leaves are named by the bridge and need no look-up. Deeper records
        start anew from each LEVELS-th level, all at once, so there are at most LEVELS rounds. Only then are the nodes of a whole record given
        to the rows that hold it. With last_use the tables aren't read again and their files go.
        """
        child = lambda c: F.struct(F.when(~c["leaf"], c["hash"]).alias("hash"), c["name"].alias("name"), c["place"].alias("place"))
        inner = self._both.where(F.col("row_id").isNull() & (F.size("children") > 0)).select("level", "hash", F.transform("children", child).alias("children"))
        inner = stage(inner.dropDuplicates(["level", "hash"]), "p4-inner")
        deepest = inner.agg(F.max("level")).first()[0] or 0
        rows = self.rows
        if last_use:
            rows = stage(rows, "p4-rows")
            drop_stage(self._both)
        entries = inner.where("level = -1").select(F.col("hash").alias("whole"), F.explode("children").alias("c")).select("whole", F.col("c.place").alias("base"), F.col("c.hash").alias("hash"))
        at = inner.where("level = 0").select(F.col("hash").alias("whole"), F.lit(0).alias("base"), "children")
        at = at.unionByName(entries.join(inner.where(F.col("level") == LEVELS).select("hash", "children"), "hash").select("whole", "base", "children"))
        levels: list[DataFrame] = []
        for level in range(1, LEVELS + 1):
            now = at.select("whole", F.col("base").alias("parent_no"), F.explode("children").alias("c"))
            now = now.select(F.col("whole").alias("hash"), (F.col("parent_no") + F.col("c.place")).alias("node_no"), "parent_no", F.col("c.name").alias("node_name"), F.col("c.hash").alias("inner"))
            if level > deepest or level == LEVELS:
                levels.append(now.drop("inner"))
                break
            now = stage(now, "p4-level")
            levels.append(now.drop("inner"))
            open_ = now.where("inner is not null").select(F.col("hash").alias("whole"), F.col("node_no").alias("base"), F.col("inner").alias("hash"))
            at = open_.join(inner.where(F.col("level") == level).select("hash", "children"), "hash").select("whole", "base", "children")
        nodes = levels[0]
        for x in levels[1:]:
            nodes = nodes.unionByName(x)
        return salted_join(rows, nodes, "hash").select("row_id", "node_no", "parent_no", "node_name")
