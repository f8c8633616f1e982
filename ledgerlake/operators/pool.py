"""The manifest pool of each table, and the snapshots' ordered references to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool(manifests: DataFrame, order: str) -> DataFrame:
    """One entry for each table and path: the last entry wins, the first place is kept."""
    rest = [c for c in manifests.columns if c not in ("tbl_id", "path", order)]
    g = manifests.groupBy("tbl_id", "path").agg(F.min(order).alias("first_seen"), F.max_by(F.struct(*rest), order).alias("_e"))
    return g.select("tbl_id", "path", "first_seen", "_e.*")


def indexed(p: DataFrame) -> DataFrame:
    """p with pool_idx, from 0 in order of first insertion; ties in order of path."""
    w = Window.partitionBy("tbl_id").orderBy("first_seen", "path")
    return p.withColumn("pool_idx", (F.row_number().over(w) - 1).cast("long"))


def positional(refs: DataFrame, p: DataFrame) -> DataFrame:
    """References by path as references by place; paths that the pool lacks are dropped."""
    return refs.join(p.select("tbl_id", "path", "pool_idx"), ["tbl_id", "path"])


def by_path(refs: DataFrame, p: DataFrame) -> DataFrame:
    """The way back; places out of range are dropped."""
    return refs.join(p.select("tbl_id", "path", "pool_idx"), ["tbl_id", "pool_idx"])


def carried_forward(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """tbl_id, snapshot_id, n_refs: how many manifests each snapshot of a linear history refers to, its own and inherited ones.
    Only the first snapshot of each path counts, so the running sum is over numbers, and no list is carried along."""
    at = snapshots.select("tbl_id", "snapshot_id", "ts_ms")
    first = manifests.select("tbl_id", "snapshot_id", "path").join(at, ["tbl_id", "snapshot_id"])
    first = first.groupBy("tbl_id", "path").agg(F.min_by("snapshot_id", F.struct("ts_ms", "snapshot_id")).alias("snapshot_id"))
    fresh = first.groupBy("tbl_id", "snapshot_id").agg(F.count("*").alias("n"))
    own = manifests.select("tbl_id", "snapshot_id").distinct()
    w = Window.partitionBy("tbl_id").orderBy("ts_ms", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    all_ = at.join(fresh, ["tbl_id", "snapshot_id"], "left").withColumn("n_refs", F.sum(F.coalesce("n", F.lit(0))).over(w))
    return all_.join(own, ["tbl_id", "snapshot_id"], "left_semi").select("tbl_id", "snapshot_id", "n_refs")


def without_path(refs: DataFrame, path: str) -> DataFrame:
    """refs(…, paths array) without one exact path."""
    return refs.withColumn("paths", F.filter("paths", lambda p: p != path))


def as_lists(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("tbl_id", "snapshot_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def resolved(refs: DataFrame, p: DataFrame) -> DataFrame:
    """refs(tbl_id, snapshot_id, ord, path) with the pool's entries; what the pool lacks is skipped."""
    return refs.join(p, ["tbl_id", "path"])


def collected(p: DataFrame, refs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The pool after dropping snapshots(tbl_id, snapshot_id): entries that a dropped snapshot held and no other holds are gone."""
    left = refs.join(dropped, ["tbl_id", "snapshot_id"], "left_anti").select("tbl_id", "path").distinct()
    held = refs.join(dropped, ["tbl_id", "snapshot_id"], "left_semi").select("tbl_id", "path").distinct()
    return p.join(held.join(left, ["tbl_id", "path"], "left_anti"), ["tbl_id", "path"], "left_anti")


def garbage(refs: DataFrame, dropped: DataFrame) -> DataFrame:
    left = refs.join(dropped, ["tbl_id", "snapshot_id"], "left_anti").select("tbl_id", "path")
    return refs.join(dropped, ["tbl_id", "snapshot_id"], "left_semi").select("tbl_id", "path").distinct().join(left, ["tbl_id", "path"], "left_anti")


def manifest_diff(refs: DataFrame, of: DataFrame) -> DataFrame:
    """of(tbl_id, snapshot_id, parent_id): tbl_id, snapshot_id, path, change against the parent."""
    mine = of.select("tbl_id", "snapshot_id").join(refs.select("tbl_id", "snapshot_id", "path"), ["tbl_id", "snapshot_id"])
    base = of.filter("parent_id IS NOT NULL").select("tbl_id", "snapshot_id", F.col("parent_id").alias("_p"))
    base = base.join(refs.select("tbl_id", F.col("snapshot_id").alias("_p"), "path"), ["tbl_id", "_p"]).select("tbl_id", "snapshot_id", "path")
    k = ["tbl_id", "snapshot_id", "path"]
    return mine.join(base, k, "left_anti").select(*k, F.lit("added").alias("change")).unionByName(base.join(mine, k, "left_anti").select(*k, F.lit("removed").alias("change")))


def broken_sentinels(snapshots: DataFrame, refs: DataFrame) -> DataFrame:
    """Snapshots said to be inline that have no references."""
    return snapshots.join(refs.select("tbl_id", "snapshot_id").distinct(), ["tbl_id", "snapshot_id"], "left_anti")


def mixed_modes(lists: DataFrame) -> DataFrame:
    """lists(tbl_id, is_inline): tables with inline and external manifest lists at once."""
    g = lists.groupBy("tbl_id").agg((F.bool_or("is_inline") & F.bool_or(~F.col("is_inline"))).alias("mixed"))
    return g.filter("mixed").select("tbl_id")


def parent_manifests(of: DataFrame, new: DataFrame, current: DataFrame, pooled: DataFrame) -> DataFrame:
    """of(tbl_id, snapshot_id, parent_id): where the manifests that a snapshot begins with are found. step 1: its parent is an inline snapshot of the new
    metadata; 2: of the current metadata; 3: in the pool; 4: nowhere, or there is no parent, so it begins with none. The three relations have
    (tbl_id, snapshot_id); base_id is the parent, or null at step 4."""
    p = of.select("tbl_id", "snapshot_id", "parent_id")
    for k, have in enumerate((new, current, pooled), 1):
        p = p.join(have.select("tbl_id", F.col("snapshot_id").alias("parent_id"), F.lit(k).alias(f"_{k}")).distinct(), ["tbl_id", "parent_id"], "left")
    step = F.coalesce("_1", "_2", "_3", F.lit(4))
    return p.select("tbl_id", "snapshot_id", step.alias("step"), F.when(step < 4, F.col("parent_id")).alias("base_id"))


def ancestors(snapshots: DataFrame) -> DataFrame:
    """tbl_id, snapshot_id, at, back: every snapshot with each of its ancestors, itself included, and how far back that is. The jumps double with each round,
    so a history of n snapshots takes log2(n) joins."""
    jump = snapshots.filter("parent_id IS NOT NULL").select("tbl_id", F.col("snapshot_id").alias("at"), F.col("parent_id").alias("to"))
    have, size = snapshots.select("tbl_id", "snapshot_id", F.col("snapshot_id").alias("at"), F.lit(0).alias("back")), 1
    while jump.limit(1).count():
        have = have.unionByName(have.join(jump, ["tbl_id", "at"]).select("tbl_id", "snapshot_id", F.col("to").alias("at"), (F.col("back") + size).alias("back")))
        far = jump.select("tbl_id", F.col("at").alias("to"), F.col("to").alias("end"))
        jump, size = jump.join(far, ["tbl_id", "to"]).select("tbl_id", "at", F.col("end").alias("to")), 2 * size
    return have


def carried_lists(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """tbl_id, snapshot_id, ord, path: the ordered references of each snapshot, its parent's first and then its own new ones in order of path. Histories
    branch: snapshots have parent_id. Each reference is handed down to each descendant, and no list is carried along."""
    own = manifests.select("tbl_id", "snapshot_id", "path").distinct()
    held = ancestors(snapshots).join(own.select("tbl_id", F.col("snapshot_id").alias("at"), "path"), ["tbl_id", "at"])
    first = held.groupBy("tbl_id", "snapshot_id", "path").agg(F.max("back").alias("back"))  # the farthest ancestor added it
    w = Window.partitionBy("tbl_id", "snapshot_id").orderBy(F.desc("back"), "path")
    return first.select("tbl_id", "snapshot_id", (F.row_number().over(w) - 1).cast("long").alias("ord"), "path")


def resolved_lists(refs: DataFrame, p: DataFrame) -> DataFrame:
    """refs(tbl_id, snapshot_id, ord, path) as one row for each snapshot: the pool's entries in order of ord; what the pool lacks is skipped."""
    r = refs.join(p.drop("first_seen"), ["tbl_id", "path"])
    entry = F.struct("ord", "path", *[c for c in p.columns if c not in ("tbl_id", "path", "first_seen")])
    return r.groupBy("tbl_id", "snapshot_id").agg(F.array_sort(F.collect_list(entry)).alias("manifests"))


def bounds(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("tbl_id").agg(F.min("lower_ms").alias("lower_ms"), F.max("upper_ms").alias("upper_ms"), F.count("*").alias("n_manifests"))
