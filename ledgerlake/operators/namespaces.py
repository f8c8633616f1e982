"""Namespaces and tables: paths, listings, look-ups, allocation of ids.

Relations: namespaces(ns_id, parent_id, name, version), with 0 as the virtual root; tables(tbl_id, ns_id, name, version,
location), where a null location marks an inline table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_dir

SEP = "."


def paths(namespaces: DataFrame) -> DataFrame:
    """ns_id, path (array of names from the root on), depth. Namespaces that the root doesn't reach have no row."""
    return namespaces.sparkSession.sql(
        """
        WITH RECURSIVE walk(ns_id, path) AS (
          SELECT ns_id, array(name) FROM {ns} WHERE parent_id = 0
          UNION ALL
          SELECT c.ns_id, concat(w.path, array(c.name)) FROM walk w JOIN {ns} c ON c.parent_id = w.ns_id)
        SELECT ns_id, path, size(path) AS depth FROM walk
        """,
        ns=namespaces,
    )


def dotted(path: str = "path"):
    return F.array_join(path, SEP)


def ancestors(p: DataFrame) -> DataFrame:
    """Every prefix of every path, itself included: what creating a namespace must find or make."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i)))
    return p.select("ns_id", prefix.alias("ancestor"))


def name_and_parent(p: DataFrame) -> DataFrame:
    return p.select("ns_id", F.element_at("path", -1).alias("name"), F.slice("path", F.lit(1), F.size("path") - 1).alias("parent"))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with `name`, from 1 in the given order. Numbers are dealt by prefix sums over ranges of the order, so the rows aren't sorted in one
    task; only a count for each range is."""
    spark = df.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # written once: both uses below must see the same ranges
    path = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def creation_order(p: DataFrame) -> DataFrame:
    """Parents before children; ties in order of path."""
    return numbered(p, "ord", F.size("path"), dotted())


def children(namespaces: DataFrame, parent_id: int) -> DataFrame:
    return namespaces.filter(F.col("parent_id") == parent_id)


def qualified(tables: DataFrame, p: DataFrame) -> DataFrame:
    """tables with fqn, the dotted name; tables in the root have their name only."""
    named = tables.join(p.select("ns_id", dotted().alias("ns")), "ns_id", "left")
    return named.withColumn("fqn", F.concat_ws(SEP, "ns", "name"))


def list_tables(tables: DataFrame, p: DataFrame, namespace: str) -> DataFrame:
    """The tables of a namespace, and those of the root, in order of their dotted name."""
    q = qualified(tables, p)
    return q.filter((F.col("ns") == namespace) | (F.col("ns_id") == 0)).select("tbl_id", "fqn").orderBy("fqn")


def default_locations(tables: DataFrame, p: DataFrame, warehouse: str) -> DataFrame:
    q = tables.join(p.select("ns_id", "path"), "ns_id")
    return q.select("tbl_id", F.concat_ws("/", F.lit(warehouse), F.array_join("path", "/"), "name").alias("default_location"))


def modes(tables: DataFrame) -> DataFrame:
    return tables.select("tbl_id", F.when(F.col("location").isNull(), "inline").otherwise("pointer").alias("mode"))


def droppable(namespaces: DataFrame, tables: DataFrame) -> DataFrame:
    """Namespaces without a namespace or a table in them."""
    n = namespaces.join(namespaces.select(F.col("parent_id").alias("ns_id")).distinct(), "ns_id", "left_anti")
    return n.join(tables.select("ns_id").distinct(), "ns_id", "left_anti")


def create_checks(wanted: DataFrame, tables: DataFrame, namespaces: DataFrame) -> DataFrame:
    """wanted(ns_id, name) with outcome: no_namespace, exists or ok."""
    ns = namespaces.select("ns_id", F.lit(True).alias("has_ns"))
    have = tables.select("ns_id", "name", F.lit(True).alias("has_tbl")).distinct()
    w = wanted.join(ns, "ns_id", "left").join(have, ["ns_id", "name"], "left")
    outcome = F.when(F.col("has_ns").isNull(), "no_namespace").when(F.col("has_tbl"), "exists").otherwise("ok")
    return w.withColumn("outcome", outcome).drop("has_ns", "has_tbl")


def allocated(wanted: DataFrame, existing: DataFrame, order: str, stored_next: int = 1) -> DataFrame:
    """wanted with new_id: from the larger of the stored counter and the largest id in use plus one, in the given order."""
    top = existing.agg(F.max("id")).first()[0]
    base = max(stored_next, (top or 0) + 1)
    return numbered(wanted, "new_id", order).withColumn("new_id", F.col("new_id") + (base - 1))


def late_bound(references: DataFrame, existing: DataFrame, new_ids: DataFrame) -> DataFrame:
    """references(name) with id and captured version: those of an existing entity, or the id allocated in this transaction with version -1."""
    r = references.join(existing.select("name", F.col("id").alias("_old"), F.col("version").alias("_v")), "name", "left")
    r = r.join(new_ids.select("name", F.col("new_id").alias("_new")), "name", "left")
    return r.select("name", F.coalesce("_old", "_new").alias("id"), F.coalesce("_v", F.lit(-1)).alias("version"))


def bumped(namespaces: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions after changes(ns_id), one bump each; the root has no version."""
    n = changes.filter("ns_id <> 0").groupBy("ns_id").agg(F.count("*").alias("n"))
    return namespaces.join(n, "ns_id", "left").select("ns_id", (F.col("version") + F.coalesce("n", F.lit(0))).alias("version"))


def current_properties(log: DataFrame) -> DataFrame:
    """log(owner, key, value, pos): the last value of each key; a null value removes it."""
    last = log.groupBy("owner", "key").agg(F.max_by(F.struct("value"), "pos").alias("v"))
    return last.select("owner", "key", F.col("v.value").alias("value")).filter("value IS NOT NULL")


def property_maps(log: DataFrame) -> DataFrame:
    return current_properties(log).groupBy("owner").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))


def without_keys(properties: DataFrame, removed: DataFrame) -> DataFrame:
    return properties.join(removed, ["owner", "key"], "left_anti")
