"""Every query over the lake relations, and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, state
from ..functions.shipping import ship
from ..sources.storage import shared_dir
from ..operators import log, metadata, namespaces, pool
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Namespaces in a transaction of commit_reload.
BATCH = 500
#: Paths in DuckDB, for the queries that need them.
_WALK = """,
walk(ns_id, path) AS (SELECT ns_id, [name] FROM namespaces WHERE parent_id = 0
  UNION ALL SELECT c.ns_id, list_append(w.path, c.name) FROM walk w JOIN namespaces c ON c.parent_id = w.ns_id)"""


def query(sql: str | None = None):
    """Registers build(rel) under its name; rel gives a relation by its name. sql follows the relations' common table expressions."""

    def deco(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(lambda name: fixtures.relation(spark, sf_dir, name))

        run.__name__ = build.__name__
        QUERIES[build.__name__] = run
        if sql:
            s = sql.strip()
            ORACLES[build.__name__] = fixtures.duckdb_ctes() + (_WALK if "walk" in s else "") + (",\n" if s.startswith("+") else "\n") + s.removeprefix("+")
        return build

    return deco


# Namespaces and tables


@query("SELECT ns_id, array_to_string(path, '.') AS path, len(path)::INTEGER AS depth FROM walk")
def ns_paths(rel):
    return namespaces.paths(rel("namespaces")).select("ns_id", namespaces.dotted().alias("path"), "depth")


@query("SELECT ns_id, array_to_string(path[1:i], '.') AS ancestor FROM (SELECT ns_id, path, unnest(range(1, len(path) + 1)) AS i FROM walk)")
def ns_ancestors(rel):
    return namespaces.ancestors(namespaces.paths(rel("namespaces"))).select("ns_id", namespaces.dotted("ancestor").alias("ancestor"))


@query("SELECT ns_id, row_number() OVER (ORDER BY len(path), array_to_string(path, '.')) AS ord FROM walk")
def ns_depth_order(rel):
    return namespaces.creation_order(namespaces.paths(rel("namespaces"))).select("ns_id", "ord")


@query("SELECT ns_id, path[-1] AS name, array_to_string(path[1:len(path) - 1], '.') AS parent FROM walk")
def ns_name_parent(rel):
    return namespaces.name_and_parent(namespaces.paths(rel("namespaces"))).select("ns_id", "name", namespaces.dotted("parent").alias("parent"))


@query("SELECT ns_id, name FROM namespaces WHERE parent_id = 1")
def ns_children(rel):
    return namespaces.children(rel("namespaces"), 1).select("ns_id", "name")


@query("SELECT tbl_id, array_to_string(path, '.') || '.' || t.name AS fqn FROM tables t JOIN walk w ON t.ns_id = w.ns_id")
def tbl_fqn(rel):
    return namespaces.qualified(rel("tables"), namespaces.paths(rel("namespaces"))).select("tbl_id", "fqn")


@query("SELECT tbl_id, array_to_string(path, '.') || '.' || t.name AS fqn FROM tables t JOIN walk w ON t.ns_id = w.ns_id WHERE w.ns_id = 100")
def tbl_list_ns(rel):
    ns, t = rel("namespaces"), rel("tables")
    p = namespaces.paths(ns)
    mine = p.filter("ns_id = 100")
    return namespaces.qualified(t, mine).filter("ns IS NOT NULL OR ns_id = 0").select("tbl_id", "fqn").orderBy("fqn")


@query("SELECT tbl_id, 's3://wh/' || array_to_string(path, '/') || '/' || t.name AS default_location FROM tables t JOIN walk w ON t.ns_id = w.ns_id")
def tbl_default_location(rel):
    return namespaces.default_locations(rel("tables"), namespaces.paths(rel("namespaces")), "s3://wh")


@query("SELECT mode, count(*) AS n FROM (SELECT CASE WHEN location IS NULL THEN 'inline' ELSE 'pointer' END AS mode FROM tables) GROUP BY mode")
def tbl_mode(rel):
    return namespaces.modes(rel("tables")).groupBy("mode").agg(F.count("*").alias("n"))


@query("""SELECT ns_id, name FROM namespaces n WHERE NOT EXISTS (SELECT 1 FROM namespaces c WHERE c.parent_id = n.ns_id)
  AND NOT EXISTS (SELECT 1 FROM tables t WHERE t.ns_id = n.ns_id)""")
def ns_droppable(rel):
    return namespaces.droppable(rel("namespaces"), rel("tables")).select("ns_id", "name")


_LAST = """+last AS (SELECT owner, key, arg_max(CASE WHEN value = 'error' THEN '' ELSE value END, pos) AS value FROM properties GROUP BY owner, key)"""


def _removing(props):
    """The fixture's errors are removals."""
    return props.withColumn("value", F.when(F.col("value") != "error", F.col("value")))


@query(_LAST + "SELECT owner, string_agg(key || '=' || value, ',' ORDER BY key) AS properties FROM last WHERE value <> '' GROUP BY owner")
def ns_props_map(rel):
    m = namespaces.property_maps(_removing(rel("properties")))
    return m.select("owner", F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("properties"))


@query(_LAST + "SELECT owner, key, value FROM last l WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM properties p WHERE p.owner = l.owner AND p.key = l.key AND p.pos % 11 = 0)")
def prop_remove(rel):
    p = rel("properties")
    return namespaces.without_keys(namespaces.current_properties(_removing(p)), p.filter("pos % 11 = 0").select("owner", "key").distinct())


@query("""+w AS (SELECT DISTINCT cast(s_suppkey % 40 + 95 AS INTEGER) AS ns_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || 'n' END AS name FROM supplier)
SELECT ns_id, name, CASE WHEN NOT EXISTS (SELECT 1 FROM namespaces n WHERE n.ns_id = w.ns_id) THEN 'no_namespace'
  WHEN EXISTS (SELECT 1 FROM tables t WHERE t.ns_id = w.ns_id AND t.name = w.name) THEN 'exists' ELSE 'ok' END AS outcome FROM w""")
def create_conflicts(rel):
    w = rel("tables").filter("location IS NULL").select("tbl_id", "name").withColumn("k", F.col("tbl_id") - 10_000_000)
    w = w.select((F.col("k") % 40 + 95).cast("int").alias("ns_id"), F.when(F.col("k") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("n"))).alias("name")).distinct()
    return namespaces.create_checks(w, rel("tables"), rel("namespaces")).select("ns_id", "name", "outcome")


@query("SELECT id, (SELECT max(tbl_id) FROM tables) + row_number() OVER (ORDER BY id) AS new_id FROM new_meta")
def id_alloc(rel):
    return namespaces.allocated(rel("new_meta").select("id"), rel("tables").select(F.col("tbl_id").alias("id")), "id").select("id", "new_id")


_REFS = "+r AS (SELECT name FROM tables WHERE tbl_id % 2 = 0), e AS (SELECT name, tbl_id AS id, version FROM tables WHERE tbl_id % 3 <> 0), n AS (SELECT name, row_number() OVER (ORDER BY tbl_id) + 20000000 AS id FROM tables WHERE tbl_id % 6 = 0)"


@query(_REFS + " SELECT r.name, coalesce(e.id, n.id) AS id, coalesce(version, -1) AS version FROM r LEFT JOIN e ON r.name = e.name LEFT JOIN n ON r.name = n.name")
def late_bind(rel):
    t = rel("tables")
    new = namespaces.allocated(t.filter("tbl_id % 6 = 0").select("name", "tbl_id"), t.select(F.lit(20_000_000).alias("id")), "tbl_id")
    return namespaces.late_bound(t.filter("tbl_id % 2 = 0").select("name"), t.filter("tbl_id % 3 <> 0").select("name", F.col("tbl_id").alias("id"), "version"), new)


@query("SELECT n.ns_id, (any_value(n.version) + count(t.tbl_id))::BIGINT AS version FROM namespaces n LEFT JOIN tables t ON n.ns_id = t.ns_id GROUP BY n.ns_id")
def ns_version_bump(rel):
    return namespaces.bumped(rel("namespaces"), rel("tables").select("ns_id"))


# The log


@query("SELECT entity, k, min(pos) AS pos FROM txn_log GROUP BY entity, k")
def txn_dedup(rel):
    return log.first_of_each(rel("txn_log"), "entity", "k").select("entity", "k", "pos")


@query("SELECT pos, entity FROM txn_log WHERE pos <= coalesce((SELECT min(pos) FROM txn_log WHERE sealed), (SELECT max(pos) FROM txn_log))")
def txn_seal_cut(rel):
    return log.until_seal(rel("txn_log")).select("pos", "entity")


@query("SELECT count(*) AS appends FROM txn_log WHERE pos <= coalesce((SELECT min(pos) FROM txn_log WHERE sealed), (SELECT max(pos) FROM txn_log))")
def append_count(rel):
    return log.append_count(rel("txn_log"))


@query("SELECT pos, bool_and(captured % 5 <> 0) OVER (PARTITION BY pos // 4) AS txn_ok FROM txn_log")
def txn_atomic(rel):
    actions = rel("txn_log").withColumn("txn", F.expr("pos div 4"))
    return log.atomic(actions, "txn", F.col("captured") % 5 != 0).select("pos", "txn_ok")


_FOLD = """+s AS (SELECT entity, pos, captured, row_number() OVER (PARTITION BY entity ORDER BY pos) AS rn FROM txn_log),
f(entity, rn, pos, v, ok, n) AS (
  SELECT entity, 0::BIGINT, NULL::BIGINT, 1::BIGINT, false, 0::BIGINT FROM (SELECT DISTINCT entity FROM s)
  UNION ALL SELECT s.entity, s.rn, s.pos, CASE WHEN captured = v THEN v + 1 ELSE v END, captured = v, CASE WHEN captured = v THEN n + 1 ELSE n END
  FROM f JOIN s ON s.entity = f.entity AND s.rn = f.rn + 1)
"""


@query(_FOLD + "SELECT entity, arg_max(v, rn) AS version, arg_max(n, rn) AS accepted FROM f GROUP BY entity")
def replay_versions(rel):
    return log.final_versions(rel("txn_log"))


@query(_FOLD + "SELECT entity, pos, ok AS accepted FROM f WHERE rn > 0")
def replay_outcomes(rel):
    return log.outcomes(rel("txn_log"))


@query("SELECT id AS tbl_id, id % 2 AS version FROM new_meta m WHERE EXISTS (SELECT 1 FROM tables t WHERE t.tbl_id = m.id AND t.version = m.id % 2)")
def read_validation(rel):
    reads = rel("new_meta").select(F.col("id").alias("tbl_id"), (F.col("id") % 2).alias("version"))
    return log.validated_reads(reads, rel("tables")).select("tbl_id", "version")


@query("""+k(kind, w, n) AS (VALUES ('create_namespace', ['ns'], ['ns']), ('drop_namespace', ['ns'], ['ns']), ('set_property', ['ns'], ['ns']),
  ('remove_property', ['ns'], ['ns']), ('create_table', ['ns'], ['ns']), ('create_table_inline', ['ns'], ['ns']), ('drop_table', ['ns', 'tbl'], ['tbl']),
  ('update_table', ['tbl'], ['tbl']), ('update_table_inline', ['tbl'], ['tbl']), ('read_table', []::VARCHAR[], ['tbl']))
SELECT a.kind AS first, b.kind AS second, list_has_any(a.w, b.n) AS conflicts FROM k a, k b""")
def conflict_matrix(rel):
    return log.conflict_matrix(rel("namespaces").sparkSession)


@query("SELECT entity, pos, CASE WHEN (row_number() OVER (PARTITION BY entity ORDER BY pos) - 1) % 3 = 0 THEN 'cas' ELSE 'append' END AS mode FROM txn_log")
def append_vs_cas(rel):
    return log.commit_modes(rel("txn_log"), 3)


# Metadata


@query("SELECT tbl_id, snapshot_id, row_number() OVER (PARTITION BY tbl_id ORDER BY ts_ms, snapshot_id) AS sequence_number FROM snapshots")
def snap_sequence(rel):
    return metadata.sequences(rel("snapshots")).select("tbl_id", "snapshot_id", "sequence_number")


@query("SELECT tbl_id, snapshot_id, coalesce(lag(snapshot_id) OVER (PARTITION BY tbl_id ORDER BY ts_ms, snapshot_id), -1) AS parent FROM snapshots")
def snap_parent(rel):
    return metadata.parents(rel("snapshots").withColumn("parent_id", F.lit(None).cast("long"))).select("tbl_id", "snapshot_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("SELECT tbl_id, snapshot_id, ts_ms FROM snapshots")
def snap_timestamps(rel):
    d = metadata.sequences(metadata.deltas_of_time(rel("snapshots"))).withColumnRenamed("sequence_number", "ord")
    return metadata.times_of_deltas(d.select("tbl_id", "snapshot_id", "ord", "delta_ms")).select("tbl_id", "snapshot_id", "ts_ms")


@query("SELECT tbl_id, last(snapshot_id ORDER BY ts_ms, snapshot_id) AS snapshot_id FROM snapshots GROUP BY tbl_id")
def snap_current(rel):
    return metadata.current(rel("snapshots"))


@query("SELECT tbl_id, snapshot_id, CASE WHEN operation = 'append' THEN 'inline://' || snapshot_id ELSE 's3://wh/snap-' || operation || '.avro' END AS manifest_list FROM snapshots")
def snap_sentinel(rel):
    suffix = F.when(F.col("operation") == "append", "").otherwise(F.concat(F.lit("snap-"), "operation", F.lit(".avro")))
    return metadata.manifest_lists(rel("snapshots"), F.lit("s3://wh/"), suffix).select("tbl_id", "snapshot_id", "manifest_list")


@query("SELECT id, value FROM new_meta WHERE id NOT IN (SELECT id FROM old_meta)")
def diff_added(rel):
    return metadata.added(rel("old_meta"), rel("new_meta"), "id")


@query("SELECT id, value FROM old_meta WHERE id NOT IN (SELECT id FROM new_meta)")
def diff_removed(rel):
    return metadata.removed(rel("old_meta"), rel("new_meta"), "id")


@query("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'remove' ELSE 'set' END AS change, n.value FROM old_meta o
  FULL JOIN new_meta n ON o.id = n.id WHERE n.id IS NULL OR o.id IS NULL OR o.value IS DISTINCT FROM n.value""")
def diff_properties(rel):
    return metadata.diff(rel("old_meta"), rel("new_meta"), "id", "value")


@query("SELECT n.id, n.value FROM new_meta n LEFT JOIN old_meta o ON o.id = n.id WHERE o.id IS NULL OR o.value IS DISTINCT FROM n.value")
def diff_refs(rel):
    return metadata.changed(rel("old_meta"), rel("new_meta"), "id", "value")


@query("SELECT count(*) > 0 AS changed FROM ((SELECT * FROM old_meta EXCEPT SELECT * FROM new_meta) UNION ALL (SELECT * FROM new_meta EXCEPT SELECT * FROM old_meta))")
def diff_stats_changed(rel):
    return metadata.differs(rel("old_meta"), rel("new_meta"))


@query("SELECT id, value FROM new_meta")
def patch_properties(rel):
    old = rel("old_meta")
    return metadata.patched(old, metadata.diff(old, rel("new_meta"), "id", "value"), "id", "value")


@query("SELECT id, CASE WHEN length(value) <= 9 THEN 'delta' WHEN length(value) + id % 7 <= 9 THEN 'full' ELSE 'pointer' END AS mode FROM new_meta")
def mode_select(rel):
    n = F.length("value").cast("long")
    return rel("new_meta").select("id", metadata.select_mode(n, n + F.col("id") % 7, 9).alias("mode"))


_UPD = "+u AS (SELECT entity AS tbl_id, k AS snapshot_id, pos, CASE WHEN event_type = 'click' THEN 'add_snapshot' ELSE 'add_manifest' END AS kind FROM txn_log)"


@query(_UPD + " SELECT tbl_id, snapshot_id, pos FROM (SELECT *, min(pos) FILTER (WHERE kind = 'add_snapshot') OVER (PARTITION BY tbl_id, snapshot_id) AS m FROM u) WHERE kind <> 'add_snapshot' AND (m IS NULL OR pos < m)")
def delta_order_check(rel):
    u = rel("txn_log").select(F.col("entity").alias("tbl_id"), F.col("k").alias("snapshot_id"), "pos", F.when(F.col("event_type") == "click", "add_snapshot").otherwise("add_manifest").alias("kind"))
    return metadata.order_violations(u).select("tbl_id", "snapshot_id", "pos")


@query("SELECT v AS x, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS coded, v AS back FROM (SELECT (pos % 2 * 2 - 1) * pos * pos AS v FROM txn_log)")
def zigzag_roundtrip(rel):
    x = rel("txn_log").select(((F.col("pos") % 2 * 2 - 1) * F.col("pos") * F.col("pos")).alias("x"))
    return x.withColumn("coded", metadata.zigzag(F.col("x"))).withColumn("back", metadata.unzigzag(F.col("coded")))


@query("""SELECT owner, coalesce(string_agg(key || '=' || v, ',' ORDER BY key) FILTER (WHERE std AND v <> '0'), '') AS standard,
  coalesce(string_agg(key || '=' || v, ',' ORDER BY key) FILTER (WHERE NOT std), '') AS extra
  FROM (SELECT owner, CASE WHEN key = 'k1' THEN 'added-records' WHEN key = 'k2' THEN 'total-records' ELSE key END AS key, max(pos % 3)::VARCHAR AS v, key IN ('k1', 'k2') AS std
        FROM properties GROUP BY owner, key) GROUP BY owner""")
def summary_split(rel):
    named = F.when(F.col("key") == "k1", "added-records").when(F.col("key") == "k2", "total-records").otherwise(F.col("key"))
    p = rel("properties").groupBy("owner", named.alias("key")).agg(F.max(F.col("pos") % 3).cast("string").alias("v"))
    m = p.groupBy("owner").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v")))).alias("summary"))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return metadata.split_summary(m, "summary").select("owner", flat("standard").alias("standard"), flat("extra").alias("extra"))


@query("SELECT tbl_id, CASE WHEN starts_with(location, 's3://wh/Customer#0000001') THEN substr(location, length('s3://wh/Customer#0000001') + 1) ELSE location END AS suffix FROM tables WHERE location IS NOT NULL")
def prefix_strip(rel):
    return rel("tables").filter("location IS NOT NULL").select("tbl_id", metadata.stripped(F.col("location"), F.lit("s3://wh/Customer#0000001")).alias("suffix"))


# The pool


_POOL = "+p AS (SELECT tbl_id, path, min(snapshot_id) AS first_seen, arg_max(content, snapshot_id) AS content, arg_max(added_rows, snapshot_id) AS added_rows FROM manifests GROUP BY tbl_id, path)"


def _pool(rel):
    return pool.pool(rel("manifests").select("tbl_id", "snapshot_id", "path", "content", "added_rows"), "snapshot_id")


@query(_POOL + " SELECT * FROM p")
def pool_dedup(rel):
    return _pool(rel)


@query(_POOL + " SELECT tbl_id, path, row_number() OVER (PARTITION BY tbl_id ORDER BY first_seen, path) - 1 AS pool_idx FROM p")
def pool_index(rel):
    return pool.indexed(_pool(rel)).select("tbl_id", "path", "pool_idx")


@query(_POOL + ", i AS (SELECT tbl_id, path, row_number() OVER (PARTITION BY tbl_id ORDER BY first_seen, path) - 1 AS pool_idx FROM p) SELECT m.tbl_id, snapshot_id, pool_idx FROM manifests m JOIN i ON m.tbl_id = i.tbl_id AND m.path = i.path")
def refs_positional(rel):
    p = pool.indexed(_pool(rel))
    return pool.positional(rel("manifests").select("tbl_id", "snapshot_id", "path"), p).select("tbl_id", "snapshot_id", "pool_idx")


@query("""+h AS (SELECT DISTINCT m.tbl_id, m.snapshot_id, m.path, s.ts_ms FROM manifests m JOIN snapshots s ON m.tbl_id = s.tbl_id AND m.snapshot_id = s.snapshot_id),
d AS (SELECT DISTINCT tbl_id, snapshot_id, ts_ms FROM h)
SELECT tbl_id, snapshot_id, (SELECT count(DISTINCT h.path) FROM h WHERE h.tbl_id = d.tbl_id AND (h.ts_ms, h.snapshot_id) <= (d.ts_ms, d.snapshot_id)) AS n_refs FROM d""")
def refs_carry_forward(rel):
    return pool.carried_forward(rel("manifests"), rel("snapshots"))


@query("SELECT tbl_id, snapshot_id, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE path <> 'm3.avro'), '') AS paths FROM manifests GROUP BY tbl_id, snapshot_id")
def refs_remove(rel):
    return pool.without_path(pool.as_lists(rel("manifests")), "m3.avro").select("tbl_id", "snapshot_id", F.array_join("paths", ",").alias("paths"))


@query(_POOL + " SELECT m.tbl_id, m.snapshot_id, m.path, p.added_rows FROM manifests m JOIN p ON m.tbl_id = p.tbl_id AND m.path = p.path WHERE p.content = 1")
def refs_resolve(rel):
    refs = rel("manifests").select("tbl_id", "snapshot_id", "path")
    return pool.resolved(refs, _pool(rel).filter("content = 1")).select("tbl_id", "snapshot_id", "path", "added_rows")


@query("""SELECT DISTINCT tbl_id, path FROM manifests m WHERE snapshot_id % 3 = 0
  AND NOT EXISTS (SELECT 1 FROM manifests k WHERE k.tbl_id = m.tbl_id AND k.path = m.path AND k.snapshot_id % 3 <> 0)""")
def pool_gc(rel):
    return pool.garbage(rel("manifests").select("tbl_id", "snapshot_id", "path"), rel("snapshots").filter("snapshot_id % 3 = 0").select("tbl_id", "snapshot_id"))


@query(_POOL + """ SELECT tbl_id, path FROM p WHERE EXISTS (SELECT 1 FROM manifests k WHERE k.tbl_id = p.tbl_id AND k.path = p.path AND k.snapshot_id % 3 <> 0)""")
def pool_after_gc(rel):
    refs = rel("manifests").select("tbl_id", "snapshot_id", "path")
    return pool.collected(_pool(rel), refs, rel("snapshots").filter("snapshot_id % 3 = 0").select("tbl_id", "snapshot_id")).select("tbl_id", "path")


@query("""+m AS (SELECT tbl_id, snapshot_id, path FROM manifests), b AS (SELECT s.tbl_id, s.snapshot_id, m.path FROM snapshots s JOIN m ON m.tbl_id = s.tbl_id AND m.snapshot_id = s.parent_id),
o AS (SELECT s.tbl_id, s.snapshot_id, m.path FROM snapshots s JOIN m ON m.tbl_id = s.tbl_id AND m.snapshot_id = s.snapshot_id)
SELECT *, 'added' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM o)""")
def manifest_diff(rel):
    return pool.manifest_diff(rel("manifests"), rel("snapshots"))


@query("SELECT tbl_id, snapshot_id FROM snapshots s WHERE NOT EXISTS (SELECT 1 FROM manifests m WHERE m.tbl_id = s.tbl_id AND m.snapshot_id = s.snapshot_id)")
def integrity_sentinel(rel):
    return pool.broken_sentinels(rel("snapshots"), rel("manifests")).select("tbl_id", "snapshot_id")


@query("SELECT tbl_id FROM snapshots GROUP BY tbl_id HAVING bool_or(operation = 'append') AND bool_or(operation <> 'append')")
def mixed_mode(rel):
    return pool.mixed_modes(rel("snapshots").select("tbl_id", (F.col("operation") == "append").alias("is_inline")))


@query("""SELECT tbl_id, snapshot_id, step, CASE WHEN step < 4 THEN parent_id ELSE -1 END AS base_id FROM (SELECT tbl_id, snapshot_id, parent_id,
  CASE WHEN parent_id % 5 = 0 THEN 1 WHEN parent_id % 3 = 0 THEN 2 WHEN parent_id % 2 = 0 AND EXISTS (SELECT 1 FROM manifests m WHERE m.tbl_id = s.tbl_id AND m.snapshot_id = s.parent_id) THEN 3 ELSE 4 END AS step FROM snapshots s)""")
def parent_manifests(rel):
    s = rel("snapshots")
    pooled = rel("manifests").filter("snapshot_id % 2 = 0")
    return pool.parent_manifests(s, s.filter("snapshot_id % 5 = 0"), s.filter("snapshot_id % 3 = 0"), pooled).withColumn("base_id", F.coalesce("base_id", F.lit(-1)))


#: The lists of a linear history: a path keeps the place that its first snapshot gave it.
_LISTS = """+r AS (SELECT tbl_id, snapshot_id, row_number() OVER (PARTITION BY tbl_id ORDER BY ts_ms, snapshot_id) AS rn FROM snapshots),
f AS (SELECT m.tbl_id, path, min(rn) AS first FROM manifests m JOIN r ON r.tbl_id = m.tbl_id AND r.snapshot_id = m.snapshot_id GROUP BY m.tbl_id, path),
l AS (SELECT r.tbl_id, r.snapshot_id, row_number() OVER (PARTITION BY r.tbl_id, r.snapshot_id ORDER BY first, path) - 1 AS ord, path FROM r JOIN f ON f.tbl_id = r.tbl_id AND first <= rn)
"""


@query(_LISTS + "SELECT * FROM l")
def refs_carry_lists(rel):
    return pool.carried_lists(rel("manifests"), rel("snapshots"))


#: Branches: every snapshot's parent is the one that stands at half its place.
_BRANCHES = """+r AS (SELECT tbl_id, snapshot_id, row_number() OVER (PARTITION BY tbl_id ORDER BY ts_ms, snapshot_id) AS rn FROM snapshots),
b AS (SELECT r.tbl_id, r.snapshot_id, p.snapshot_id AS parent_id FROM r LEFT JOIN r p ON p.tbl_id = r.tbl_id AND p.rn = r.rn // 2),
u(tbl_id, snapshot_id, anc, back) AS (SELECT tbl_id, snapshot_id, snapshot_id, 0 FROM b
  UNION ALL SELECT u.tbl_id, u.snapshot_id, b.parent_id, back + 1 FROM u JOIN b ON b.tbl_id = u.tbl_id AND b.snapshot_id = u.anc WHERE b.parent_id IS NOT NULL),
h AS (SELECT u.tbl_id, u.snapshot_id, path, max(back) AS back FROM u JOIN manifests m ON m.tbl_id = u.tbl_id AND m.snapshot_id = u.anc GROUP BY 1, 2, 3)
"""


@query(_BRANCHES + "SELECT tbl_id, snapshot_id, string_agg(path, ',' ORDER BY back DESC, path) AS paths FROM h GROUP BY tbl_id, snapshot_id")
def refs_carry_branches(rel):
    from pyspark.sql import Window

    s = rel("snapshots").withColumn("rn", F.row_number().over(Window.partitionBy("tbl_id").orderBy("ts_ms", "snapshot_id")))
    parent = s.select("tbl_id", F.col("rn").alias("half"), F.col("snapshot_id").alias("parent_id"))
    of = s.select("tbl_id", "snapshot_id", F.expr("rn div 2").alias("half")).join(parent, ["tbl_id", "half"], "left")
    lists = pool.carried_lists(rel("manifests"), of).groupBy("tbl_id", "snapshot_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("l"))
    return lists.select("tbl_id", "snapshot_id", F.array_join(F.col("l.path"), ",").alias("paths"))


@query(_LISTS.rstrip() + """, p AS (SELECT tbl_id, path, arg_max(content, snapshot_id) AS content, arg_max(added_rows, snapshot_id) AS added_rows FROM manifests GROUP BY tbl_id, path)
SELECT l.tbl_id, l.snapshot_id, string_agg(l.path || ':' || added_rows, ',' ORDER BY ord) AS manifests FROM l JOIN p ON p.tbl_id = l.tbl_id AND p.path = l.path WHERE content = 1 GROUP BY 1, 2""")
def refs_resolve_ordered(rel):
    r = pool.resolved_lists(pool.carried_lists(rel("manifests"), rel("snapshots")), _pool(rel).filter("content = 1"))
    return r.select("tbl_id", "snapshot_id", F.array_join(F.transform("manifests", lambda m: F.concat(m["path"], F.lit(":"), m["added_rows"])), ",").alias("manifests"))


_VERSIONS = """+o AS (SELECT id % 50 AS tbl_id, id FROM old_meta), n AS (SELECT id % 50 AS tbl_id, id FROM new_meta)
SELECT tbl_id, 'add' AS change, id FROM n WHERE id NOT IN (SELECT id FROM o) UNION ALL
SELECT n.tbl_id, 'set', n.id FROM (SELECT tbl_id, {0}(id) AS id FROM n GROUP BY tbl_id) n LEFT JOIN (SELECT tbl_id, {0}(id) AS id FROM o GROUP BY tbl_id) o ON o.tbl_id = n.tbl_id WHERE o.id IS DISTINCT FROM n.id"""


def _list_changes(rel, which):
    o, n = (rel(x).select((F.col("id") % 50).alias("tbl_id"), "id") for x in ("old_meta", "new_meta"))
    return metadata.list_changes(o, n, *[x.groupBy("tbl_id").agg(which("id").alias("id")) for x in (o, n)])


@query(_VERSIONS.format("max"))
def schema_diff(rel):
    return _list_changes(rel, F.max)


@query(_VERSIONS.format("min"))
def spec_diff(rel):
    return _list_changes(rel, F.min)


@query("SELECT tbl_id, min(lower_ms) AS lower_ms, max(upper_ms) AS upper_ms, count(*) AS n_manifests FROM manifests GROUP BY tbl_id")
def partition_bounds(rel):
    return pool.bounds(rel("manifests"))


# Files: encoding, decoding and whole replays


def _as_text(df):
    """A lake for each namespace of the fixture: encoded as a file, read again and replayed."""
    import pandas as pd

    def encode(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                s = state.State(namespaces={r.ns_id: {"parent_id": r.parent_id, "name": r.name, "version": r.version}})
                rows.append((str(r.ns_id), codec.file_bytes(state.to_checkpoint(s))))
            yield pd.DataFrame(rows, columns=["lake", "content"])

    return df.mapInPandas(encode, "lake string, content binary")


@query("SELECT ns_id, parent_id, name, version FROM namespaces")
def codec_roundtrip(rel):
    from ..operators import replay

    return replay.replayed(_as_text(rel("namespaces")), "namespaces").select("ns_id", "parent_id", "name", "version")


@query(_FOLD + "SELECT entity, arg_max(v, rn)::INTEGER AS version FROM f GROUP BY entity")
def replay_files(rel):
    """Each entity's log as encoded transactions of a lake of its own, folded by the general replay."""
    import uuid

    import pandas as pd

    from ..operators import replay

    def encode(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                one = {"kind": "update_table", "id": 1, "version": r.captured, "metadata_location": f"v{r.captured + 1}"}
                txn = {"txn_id": str(uuid.UUID(int=r.pos)), "sealed": False, "actions": [one]}
                rows.append((str(r.entity), r.pos, codec.encode("Transaction", txn)))
            yield pd.DataFrame(rows, columns=["lake", "pos", "record"])

    def begin(batches):
        made = {"txn_id": str(uuid.UUID(int=1 << 100)), "sealed": False, "actions": [{"kind": "create_table", "id": 1, "version": 1, "namespace_id": 0, "namespace_version": -1, "name": "t", "metadata_location": "v1"}]}
        for b in batches:
            yield pd.DataFrame([(str(e), -1, codec.encode("Transaction", made)) for e in b["entity"]], columns=["lake", "pos", "record"])

    t, kind = rel("txn_log"), "lake string, pos long, record binary"
    log_ = t.select("entity", "pos", "captured").mapInPandas(encode, kind).unionByName(t.select("entity").distinct().mapInPandas(begin, kind))
    return replay.replay_transactions(log_).select(F.col("lake").cast("long").alias("entity"), "version")


def _files(df, build):
    """df(lake, facts): a file for each lake, by build(lake, facts); facts are JSON."""
    import json

    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(x, build(x, json.loads(f))) for x, f in zip(b["lake"], b["facts"])], columns=["lake", "content"])

    return df.select(F.col("lake").cast("string").alias("lake"), F.col("facts")).mapInPandas(run, "lake string, content binary")


def _facts(df, by, *cols):
    return df.groupBy(F.col(by).alias("lake")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*cols)))).alias("facts"))


def _transaction(k, *actions):
    import uuid

    return codec.encode("Transaction", {"txn_id": str(uuid.UUID(int=k + 1)), "sealed": False, "actions": list(actions)})


def _inline_table(i, name, metadata):
    import json

    return {"kind": "create_table_inline", "id": i, "version": 1, "namespace_id": 0, "namespace_version": -1, "name": name, "metadata": json.dumps(metadata).encode()}


def _history_file(lake, facts):
    """A table that is made empty, and a delta for each snapshot: the snapshot, the main branch, and its manifests."""
    from itertools import groupby

    records, clock = [_transaction(-1, _inline_table(1, "t", {"location": "l", "last-updated-ms": 0, "last-sequence-number": 0, "snapshots": []}))], 0
    for k, ((ts, i), rows) in enumerate(groupby(facts, lambda r: (r["ts_ms"], r["snapshot_id"]))):
        updates = [{"kind": "add_snapshot", "snapshot_id": i, "summary": {"operation": "append", "added-records": str(i)}, "timestamp_delta_ms": ts - clock}, {"kind": "set_ref", "name": "main", "snapshot_id": i, "type": "branch"}]
        updates += [{"kind": "add_manifest", "snapshot_id": i, "manifest": {"path": r["path"], "length": k, "added_rows": r["added_rows"], "added_snapshot_id": i}} for r in rows]
        records.append(_transaction(k, {"kind": "update_table_inline", "id": 1, "version": k + 1, "delta": codec.encode("Delta", {"updates": updates})}))
        clock = ts
    return codec.file_bytes(state.to_checkpoint(state.State()), *records)


def _histories(rel, relation):
    """Each table's snapshots with manifests, as deltas of a lake of its own, replayed."""
    from ..operators import replay

    m = rel("manifests").select("tbl_id", "snapshot_id", "path", "added_rows").join(rel("snapshots").select("tbl_id", "snapshot_id", "ts_ms"), ["tbl_id", "snapshot_id"])
    return replay.replayed(_files(_facts(m, "tbl_id", "ts_ms", "snapshot_id", "path", "added_rows"), _history_file), relation)


@query("""SELECT tbl_id, snapshot_id, coalesce(lag(snapshot_id) OVER w, -1) AS parent, row_number() OVER w AS sequence_number, ts_ms, 'inline://' || snapshot_id AS manifest_list
FROM snapshots s WHERE EXISTS (SELECT 1 FROM manifests m WHERE m.tbl_id = s.tbl_id AND m.snapshot_id = s.snapshot_id) WINDOW w AS (PARTITION BY tbl_id ORDER BY ts_ms, snapshot_id)""")
def inline_update_delta(rel):
    """Snapshots as they come out of encoded deltas: numbers, parents, times and sentinels are derived."""
    t = _histories(rel, "tables").withColumn("tbl_id", F.col("lake").cast("long"))
    return metadata.snapshots_of(t).select("tbl_id", "snapshot_id", F.coalesce("parent_id", F.lit(-1)).alias("parent"), "sequence_number", "ts_ms", "manifest_list")


@query(_LISTS + "SELECT l.* FROM l WHERE EXISTS (SELECT 1 FROM manifests m WHERE m.tbl_id = l.tbl_id AND m.snapshot_id = l.snapshot_id)")
def inline_refs(rel):
    """The ordered references of each snapshot, as encoded deltas leave them."""
    return _histories(rel, "snapshot_refs").select(F.col("lake").cast("long").alias("tbl_id"), "snapshot_id", F.col("ord").cast("long").alias("ord"), "path")


def _updates_file(lake, facts):
    """For each id a table with the value that it had, and, where there is a new one, an update of the given form; a second update
    with the version that the first has used up is rejected."""
    import json

    records = []
    for k, r in enumerate(facts):
        records.append(_transaction(3 * k, _inline_table(r["id"], f"t{r['id']}", {"location": r["old"], "properties": {"k": "v"}})))
        if r.get("new") is not None:
            form = {"metadata": json.dumps({"location": r["new"]}).encode()} if lake == "full" else {"metadata_location": r["new"]}
            records.append(_transaction(3 * k + 1, {"kind": "update_table_inline", "id": r["id"], "version": 1, **form}))
            records.append(_transaction(3 * k + 2, {"kind": "update_table_inline", "id": r["id"], "version": 1, "metadata": b'{"location": "late"}'}))
    return codec.file_bytes(state.to_checkpoint(state.State()), *records)


def _updated(rel, form):
    from ..operators import replay

    both = rel("old_meta").select("id", F.col("value").alias("old")).join(rel("new_meta").select("id", F.col("value").alias("new")), "id", "left")
    return replay.replayed(_files(_facts(both.withColumn("form", F.lit(form)), "form", "id", "old", "new"), _updates_file), "tables")


@query("SELECT o.id, CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS version, coalesce(n.value, o.value) AS location, n.id IS NULL AS has_properties FROM old_meta o LEFT JOIN new_meta n ON n.id = o.id")
def inline_update_full(rel):
    t = _updated(rel, "full")
    return t.select(F.col("tbl_id").cast("long").alias("id"), "version", F.get_json_object("metadata", "$.location").alias("location"), F.get_json_object("metadata", "$.properties").isNotNull().alias("has_properties"))


@query("SELECT o.id, CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS version, n.value AS location, n.id IS NULL AS is_inline FROM old_meta o LEFT JOIN new_meta n ON n.id = o.id")
def inline_update_pointer(rel):
    t = _updated(rel, "pointer")
    return t.select(F.col("tbl_id").cast("long").alias("id"), "version", "location", F.col("metadata").isNotNull().alias("is_inline"))


def _checkpoint_file(lake, facts):
    """A checkpoint alone: an inline table with its pool and references, a pointer table, namespaces, properties and a committed transaction."""
    import uuid

    s = state.State(committed={str(uuid.UUID(int=int(lake))): None}, namespaces={5: {"parent_id": 0, "name": f"n{lake}", "version": 3}}, properties={5: {"a": lake, "b": ""}})
    t = state.Table(5, "t", 4, None, b"{}", "m")
    for r in facts:
        t.pool.setdefault(r["path"], {"path": r["path"], "length": r["lower_ms"], "content": r["content"], "added_rows": r["added_rows"], "partitions": [{"contains_null": True, "lower_bound": b"a", "upper_bound": b"z"}]})
        t.refs.setdefault(r["snapshot_id"], []).append(r["path"])
    s.tables = {2: t, 9: state.Table(0, "p", 7, f"s3://{lake}")}
    return codec.file_bytes(state.to_checkpoint(s))


def _checkpoints(rel, relation):
    from ..operators import replay

    return replay.replayed(_files(_facts(rel("manifests"), "tbl_id", "snapshot_id", "path", "content", "added_rows", "lower_ms"), _checkpoint_file), relation)


@query("""+q AS (SELECT tbl_id, path, min(snapshot_id) AS first, arg_min(added_rows, snapshot_id) AS added_rows, arg_min(content, snapshot_id) AS content, arg_min(lower_ms, snapshot_id) AS length FROM manifests GROUP BY tbl_id, path)
SELECT tbl_id, row_number() OVER (PARTITION BY tbl_id ORDER BY first, path) - 1 AS pool_idx, path, length, content, added_rows FROM q""")
def checkpoint_roundtrip(rel):
    """The pool of an encoded checkpoint, whose paths lose and regain the prefix, and whose references are places."""
    return _checkpoints(rel, "manifest_pool").select(F.col("lake").cast("long").alias("tbl_id"), F.col("pool_idx").cast("long").alias("pool_idx"), "path", "length", "content", "added_rows")


@query("SELECT tbl_id, snapshot_id, row_number() OVER (PARTITION BY tbl_id, snapshot_id ORDER BY path) - 1 AS ord, path FROM manifests")
def checkpoint_refs(rel):
    return _checkpoints(rel, "snapshot_refs").select(F.col("lake").cast("long").alias("tbl_id"), "snapshot_id", F.col("ord").cast("long").alias("ord"), "path")


@query("""+t AS (SELECT DISTINCT tbl_id FROM manifests)
SELECT tbl_id, 'table' AS what, '2,5,t,4,inline' AS value FROM t UNION ALL SELECT tbl_id, 'table', '9,0,p,7,s3://' || tbl_id FROM t
UNION ALL SELECT tbl_id, 'property', '5,a,' || tbl_id FROM t UNION ALL SELECT tbl_id, 'property', '5,b,' FROM t
UNION ALL SELECT tbl_id, 'namespace', '5,0,n' || tbl_id || ',3' FROM t UNION ALL SELECT tbl_id, 'lake', '6,10,false' FROM t""")
def checkpoint_entities(rel):
    """Tables of both kinds, properties, namespaces and counters of an encoded checkpoint."""
    joined = lambda *c: F.concat_ws(",", *[F.coalesce(F.col(x).cast("string"), F.lit("inline")) for x in c])
    parts = [("tables", "table", ("tbl_id", "ns_id", "name", "version", "location")), ("properties", "property", ("ns_id", "key", "value")), ("namespaces", "namespace", ("ns_id", "parent_id", "name", "version")), ("lakes", "lake", ("next_ns_id", "next_tbl_id", "sealed"))]
    out = [_checkpoints(rel, r).select(F.col("lake").cast("long").alias("tbl_id"), F.lit(w).alias("what"), joined(*c).alias("value")) for r, w, c in parts]
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), out)


def _metadata_pair(r):
    i, old = r["id"], {"location": "l", "properties": {"k": r["old"], "gone": "x"}, "schemas": [{"schema-id": 0}], "current-schema-id": 0, "last-column-id": 1, "partition-specs": [{"spec-id": 0}], "default-spec-id": 0, "last-partition-id": 1, "sort-orders": [{"order-id": 0}], "default-sort-order-id": 0}
    new = dict(old, properties={"k": r["new"]})
    if i % 2 == 0:
        new |= {"schemas": [{"schema-id": 0}, {"schema-id": 1, "n": i}], "current-schema-id": 1, "last-column-id": 2}
    if i % 3 == 0:
        new |= {"partition-specs": [{"spec-id": 0}, {"spec-id": 1}], "default-spec-id": 1, "last-partition-id": 2}
    if i % 4 == 0:
        new |= {"sort-orders": [{"order-id": 0}, {"order-id": 1}], "default-sort-order-id": 1}
    return old, new | ({"location": "m"} if i % 11 == 0 else {}) | ({"statistics": [i]} if i % 13 == 0 else {})


@query("""SELECT o.id, CASE WHEN o.id % 13 = 0 THEN 'none' ELSE concat_ws(',', CASE WHEN o.id % 2 = 0 THEN 'add_schema,set_schema' END, CASE WHEN o.id % 3 = 0 THEN 'add_spec,set_spec' END,
  CASE WHEN o.id % 4 = 0 THEN 'add_order,set_order' END, 'set_properties', CASE WHEN o.id % 11 = 0 THEN 'set_location' END) END AS updates, o.id % 13 <> 0 AS same
FROM old_meta o JOIN new_meta n ON n.id = o.id""")
def delta_roundtrip(rel):
    """Differences of whole metadata as encoded deltas, applied to the old metadata again; changed statistics have no delta."""
    import pandas as pd

    from ..functions import table_metadata

    def run(batches):
        for b in batches:
            rows = []
            for i, o, n in zip(b["id"], b["old"], b["new"]):
                old, new = _metadata_pair({"id": int(i), "old": o, "new": n})
                updates = table_metadata.difference(old, new)
                again = None if updates is None else table_metadata.apply(old, codec.decode("Delta", codec.encode("Delta", {"updates": updates}))["updates"])
                rows.append((int(i), "none" if updates is None else ",".join(u["kind"] for u in updates), again == new))
            yield pd.DataFrame(rows, columns=["id", "updates", "same"])

    both = rel("old_meta").select("id", F.col("value").alias("old")).join(rel("new_meta").select("id", F.col("value").alias("new")), "id")
    return both.mapInPandas(run, "id long, updates string, same boolean")


def _actions_file(lake, facts):
    """All ten kinds and an unknown one, in several transactions, some of which are rejected."""
    n = {"namespace_id": 1}
    logs = [
        [{"kind": "create_namespace", "id": 1, "version": 1, "parent_id": 0, "parent_version": -1, "name": facts[0]["name"]}, {"kind": "create_namespace", "id": 2, "version": 1, "parent_id": 1, "parent_version": -1, "name": "b"}],
        [{"kind": "set_property", **n, "namespace_version": 2, "key": "k", "value": "v"}, {"kind": "set_property", **n, "namespace_version": 2, "key": "gone", "value": "w"}],
        [{"kind": "remove_property", **n, "namespace_version": 4, "key": "gone"}, {"kind": "unknown", "number": 77, "raw": b"later"}],
        [{"kind": "create_table", "id": 1, "version": 1, **n, "namespace_version": 5, "name": "p", "metadata_location": "l1"}, {"kind": "create_table", "id": 2, "version": 1, **n, "namespace_version": 5, "name": "q", "metadata_location": "l2"}, {"kind": "create_table_inline", "id": 3, "version": 1, **n, "namespace_version": 5, "name": "i", "metadata": b"{}"}],
        [{"kind": "read_table", "id": 2, "version": 1}, {"kind": "update_table", "id": 1, "version": 1, "metadata_location": "l3"}],
        [{"kind": "read_table", "id": 1, "version": 1}, {"kind": "drop_table", "id": 3, "version": 1}],
        [{"kind": "update_table_inline", "id": 3, "version": 1, "metadata": b'{"location": "x"}'}, {"kind": "drop_table", "id": 2, "version": 1}, {"kind": "drop_table", "id": 2, "version": 1}],
        [{"kind": "drop_namespace", "id": 2, "version": 1}],
        [{"kind": "drop_namespace", "id": 1, "version": 3}],
    ]
    return codec.file_bytes(state.to_checkpoint(state.State()), *[_transaction(k, *x) for k, x in enumerate(logs)])


@query("""SELECT s_suppkey AS id, 'table' AS what, v AS value FROM supplier, (SELECT unnest(['1,p,2,l3', '3,i,2,inline']) AS v) UNION ALL SELECT s_suppkey, 'namespace', '1,' || s_name || ',10' FROM supplier
UNION ALL SELECT s_suppkey, 'property', 'k=v' FROM supplier UNION ALL SELECT s_suppkey, 'committed', '7' FROM supplier""")
def all_actions(rel):
    """Every kind of action through bytes and the fold: what is left of each lake, and how many transactions were accepted."""
    from ..operators import replay

    files = _files(_facts(rel("tables").filter("location IS NULL").withColumn("id", F.col("tbl_id") - 10_000_000), "id", "name"), _actions_file)
    of = lambda r, w, c: replay.replayed(files, r).select(F.col("lake").cast("long").alias("id"), F.lit(w).alias("what"), c.alias("value"))
    out = of("tables", "table", F.concat_ws(",", "tbl_id", "name", "version", F.coalesce("location", F.lit("inline"))))
    out = out.unionByName(of("namespaces", "namespace", F.concat_ws(",", "ns_id", "name", "version"))).unionByName(of("properties", "property", F.concat_ws("=", "key", "value")))
    return out.unionByName(replay.replayed(files, "committed").groupBy(F.col("lake").cast("long").alias("id")).agg(F.count("*").cast("string").alias("value")).select("id", F.lit("committed").alias("what"), "value"))


@query("SELECT ns_id, parent_id, name, 1 + (SELECT count(*) FROM namespaces c WHERE c.parent_id = n.ns_id)::INTEGER AS version FROM namespaces n")
def commit_reload(rel):
    """The fixture's namespaces committed in transactions of at most BATCH of one depth, with a log of at most 7 records, and read back from the file."""
    import itertools
    import os
    import uuid

    from ..lake import Lake, Options
    from ..operators.replay import RELATIONS, rows_of
    from ..sources.storage import HadoopStore

    ns = rel("namespaces")
    spark = ns.sparkSession
    path = f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}/{os.getpid()}"
    c = Lake(path, Options(max_append_count=7), HadoopStore(spark))
    named = namespaces.paths(ns).join(ns.select("ns_id", "parent_id"), "ns_id").orderBy("depth", "ns_id")
    for _, rows in itertools.groupby(enumerate(named.toLocalIterator()), lambda x: (x[1]["depth"], x[0] // BATCH)):
        ch = c.changes()
        for _, r in rows:
            ch._ns = r["ns_id"]
            ch.create_namespace(r["path"])
        c.commit(ch)
    again = state.load(c.store.read(path)[0])
    return spark.createDataFrame(list(rows_of(path, again, "namespaces")), RELATIONS["namespaces"]).select("ns_id", "parent_id", "name", "version")
