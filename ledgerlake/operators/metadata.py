"""Table metadata: differences as joins, patches, snapshots as they are derived from deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import SUMMARY_KEYS

#: Bytes that may be stored inline.
INLINE_LIMIT = 4_190_208
SENTINEL = "inline://"


def added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (set or remove), value: what turns old into new."""
    o, n = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_ho")), new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_hn"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_hn").isNull(), "remove").when(F.col("_ho").isNull() | ~F.col("_o").eqNullSafe(F.col("_n")), "set")
    return both.select(key, change.alias("change"), F.col("_n").alias(value)).filter("change IS NOT NULL")


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Refs that are new or differ, null-safe."""
    n = new.join(old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_h")), key, "left")
    return n.filter(F.col("_h").isNull() | ~F.col(value).eqNullSafe(F.col("_o"))).select(key, value)


def list_changes(old: DataFrame, new: DataFrame, old_current: DataFrame, new_current: DataFrame) -> DataFrame:
    """tbl_id, change, id: schemas, partition specs or sort orders (tbl_id, id) that are new, and the current one (tbl_id, id) where it has become another."""
    adds = new.select("tbl_id", "id").join(old.select("tbl_id", "id"), ["tbl_id", "id"], "left_anti").select("tbl_id", F.lit("add").alias("change"), "id")
    n = new_current.select("tbl_id", "id").join(old_current.select("tbl_id", F.col("id").alias("_was")), "tbl_id", "left")
    return adds.unionByName(n.filter(~F.col("id").eqNullSafe(F.col("_was"))).select("tbl_id", F.lit("set").alias("change"), "id"))


def differs(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether the sets differ, in which case a delta can't express the change."""
    odd = old.exceptAll(new).limit(1).unionByName(new.exceptAll(old).limit(1))
    return odd.agg((F.count("*") > 0).alias("changed"))


def patched(old: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """old after delta(key, change, value)."""
    d = delta.select(key, "change", F.col(value).alias("_v"))
    both = old.join(d, key, "full_outer")
    return both.filter(~F.col("change").eqNullSafe("remove")).select(key, F.when(F.col("change") == "set", F.col("_v")).otherwise(F.col(value)).alias(value))


def select_mode(delta_bytes: Column, full_bytes: Column, limit: int = INLINE_LIMIT) -> Column:
    return F.when(delta_bytes <= limit, "delta").when(full_bytes <= limit, "full").otherwise("pointer")


def _history(*tbl: str):
    return Window.partitionBy(*tbl).orderBy("ts_ms", "snapshot_id")


def sequences(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("sequence_number", F.row_number().over(_history("tbl_id")).cast("long"))


def parents(snapshots: DataFrame) -> DataFrame:
    """The parent that is given, else the snapshot before."""
    return snapshots.withColumn("parent", F.coalesce("parent_id", F.lag("snapshot_id").over(_history("tbl_id"))))


def deltas_of_time(snapshots: DataFrame) -> DataFrame:
    """delta_ms: to the snapshot before; the first has its own time."""
    return snapshots.withColumn("delta_ms", F.col("ts_ms") - F.coalesce(F.lag("ts_ms").over(_history("tbl_id")), F.lit(0)))


def times_of_deltas(deltas: DataFrame) -> DataFrame:
    """ts_ms again, as running sums. deltas has ord, the place in the history."""
    w = Window.partitionBy("tbl_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("ts_ms", F.sum("delta_ms").over(w))


def current(snapshots: DataFrame) -> DataFrame:
    """The snapshot that the main branch names: the last."""
    return snapshots.groupBy("tbl_id").agg(F.max_by("snapshot_id", F.struct("ts_ms", "snapshot_id")).alias("snapshot_id"))


def manifest_lists(snapshots: DataFrame, prefix: Column, suffix: Column) -> DataFrame:
    location = F.when(suffix == "", F.concat(F.lit(SENTINEL), F.col("snapshot_id").cast("string"))).otherwise(F.concat(prefix, suffix))
    return snapshots.withColumn("manifest_list", location)


def order_violations(updates: DataFrame) -> DataFrame:
    """updates(tbl_id, snapshot_id, pos, kind): manifest changes that come before their snapshot is added, or without that."""
    first = F.min(F.when(F.col("kind") == "add_snapshot", F.col("pos"))).over(Window.partitionBy("tbl_id", "snapshot_id"))
    u = updates.withColumn("_first", first)
    return u.filter((F.col("kind") != "add_snapshot") & (F.col("_first").isNull() | (F.col("pos") < F.col("_first")))).drop("_first")


def split_summary(df: DataFrame, summary: str) -> DataFrame:
    """standard (without zeroes) and extra."""
    known = F.array(*[F.lit(k) for k in SUMMARY_KEYS])
    number = lambda v: v.try_cast("long")
    standard = F.map_filter(summary, lambda k, v: F.array_contains(known, k) & number(v).isNotNull() & (number(v) != 0))
    extra = F.map_filter(summary, lambda k, v: ~F.array_contains(known, k) | number(v).isNull())
    return df.withColumns({"standard": standard, "extra": extra})


def zigzag(c: Column) -> Column:
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1))))


def stripped(path: Column, prefix: Column) -> Column:
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


#: What is read of the metadata's JSON.
JSON = (
    "`format-version` int, location string, `last-sequence-number` long, `last-updated-ms` long, `current-snapshot-id` long, `current-schema-id` int, "
    "properties map<string,string>, refs map<string, struct<`snapshot-id`: long, type: string>>, "
    "snapshots array<struct<`snapshot-id`: long, `parent-snapshot-id`: long, `sequence-number`: long, `timestamp-ms`: long, `manifest-list`: string, `schema-id`: int, summary: map<string,string>>>"
)


def parsed(tables: DataFrame) -> DataFrame:
    """tables with m: their inline metadata, typed; null for pointer tables."""
    return tables.withColumn("m", F.from_json("metadata", JSON))


def snapshots_of(tables: DataFrame) -> DataFrame:
    """A row for each snapshot of each inline table."""
    s = parsed(tables).select("tbl_id", F.explode("m.snapshots").alias("s"))
    return s.select(
        "tbl_id", F.col("s.snapshot-id").alias("snapshot_id"), F.col("s.parent-snapshot-id").alias("parent_id"), F.col("s.sequence-number").alias("sequence_number"),
        F.col("s.timestamp-ms").alias("ts_ms"), F.col("s.manifest-list").alias("manifest_list"), F.col("s.summary").alias("summary"),
    )


def refs_of(tables: DataFrame) -> DataFrame:
    return parsed(tables).select("tbl_id", F.explode("m.refs").alias("ref", "r")).select("tbl_id", "ref", F.col("r.snapshot-id").alias("snapshot_id"), F.col("r.type").alias("type"))
