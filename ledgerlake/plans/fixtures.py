"""The driver's tables as lake relations. The text of each relation is valid in Spark and in DuckDB; only the few
functions in DIALECTS differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Functions whose names differ.
DIALECTS = {
    "spark": {"ms": lambda x: f"unix_millis(cast({x} AS timestamp))", "div": lambda a, b: f"({a} div {b})"},
    "duckdb": {"ms": lambda x: f"epoch_ms({x})", "div": lambda a, b: f"({a} // {b})"},
}

#: Relations in an order in which each needs only earlier ones.
RELATIONS: dict[str, str] = {
    "namespaces": """
        SELECT cast(r_regionkey + 1 AS int) AS ns_id, 0 AS parent_id, r_name AS name, 1 AS version FROM {region}
        UNION ALL SELECT cast(n_nationkey + 100 AS int), cast(n_regionkey + 1 AS int), n_name, 1 FROM {nation}""",
    "tables": """
        SELECT cast(c_custkey AS bigint) AS tbl_id, cast(c_nationkey + 100 AS int) AS ns_id, c_name AS name, 1 AS version,
          's3://wh/' || c_name AS location FROM {customer}
        UNION ALL SELECT cast(s_suppkey + 10000000 AS bigint), cast(s_nationkey + 100 AS int), s_name, 1, cast(NULL AS string) FROM {supplier}""",
    "snapshots": """
        SELECT o_custkey AS tbl_id, o_orderkey AS snapshot_id, {ms:o_orderdate} AS ts_ms,
          CASE o_orderstatus WHEN 'F' THEN 'append' WHEN 'O' THEN 'overwrite' ELSE 'replace' END AS operation,
          lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id FROM {orders}""",
    "manifests": """
        SELECT o_custkey AS tbl_id, l_orderkey AS snapshot_id, 'm' || (l_suppkey % 10) || '.avro' AS path,
          max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS content, cast(sum(l_quantity) AS bigint) AS added_rows,
          min({ms:l_shipdate}) AS lower_ms, max({ms:l_shipdate}) AS upper_ms
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "txn_log": """
        SELECT event_id AS pos, user_id AS entity, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k, event_type,
          cast(1 + {div:(row_number() OVER (PARTITION BY user_id ORDER BY event_id)),2} AS bigint) AS captured,
          event_type = 'error' AND cast(regexp_extract(props, '([0-9]+)', 1) AS int) = 0 AS sealed FROM {events}""",
    "properties": """
        SELECT cast(user_id AS bigint) AS owner, 'k' || regexp_extract(props, '([0-9]+)', 1) AS key, event_type AS value, event_id AS pos FROM {events}""",
    "old_meta": "SELECT p_partkey AS id, p_brand AS value FROM {part} WHERE p_partkey % 7 <> 0",
    "new_meta": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand || 'x' ELSE p_brand END AS value FROM {part} WHERE p_partkey % 5 <> 0",
}


def text(name: str, dialect: str) -> str:
    """The SQL of a relation, with {table} still open."""
    import re

    f = DIALECTS[dialect]
    out = re.sub(r"\{div:(.*),(\d+)\}", lambda m: f["div"](m[1], m[2]), RELATIONS[name])
    return re.sub(r"\{ms:(\w+)\}", lambda m: f["ms"](m[1]), out)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = text(name, "spark")
    used = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duckdb_ctes() -> str:
    """All relations as common table expressions."""
    parts = []
    for name in RELATIONS:
        sql = text(name, "duckdb")
        for t in TABLES:
            sql = sql.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({sql})")
    return "WITH RECURSIVE " + ",\n".join(parts)
