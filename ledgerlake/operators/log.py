"""The transaction log: dedup, seal, atomic checks, and ordered folds of versions.

Where transactions touch one entity each, the fold runs for each entity on its own, inside the JVM: an aggregate over the entity's
ordered actions. Logs whose transactions touch several entities are folded whole, by replay.replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import state

#: Actions of one entity that are folded at once.
CHUNK = 512

def first_of_each(log: DataFrame, *key: str, order: str = "pos") -> DataFrame:
    """The first record of each key, by aggregation: no sort of a hot key's records."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def until_seal(log: DataFrame) -> DataFrame:
    """Records up to and including the first sealed one. The place of the seal is one number, so it becomes a filter."""
    sql = "SELECT * FROM {log} WHERE pos <= coalesce((SELECT min(pos) FROM {log} WHERE sealed), 9223372036854775807)"
    return log.sparkSession.sql(sql, log=log)


def append_count(log: DataFrame) -> DataFrame:
    return until_seal(log).agg(F.count("*").alias("appends"))


def atomic(actions: DataFrame, txn: str, ok: Column) -> DataFrame:
    """actions with txn_ok: whether every action of the transaction holds against the state before it."""
    return actions.withColumn("txn_ok", F.bool_and(ok).over(Window.partitionBy(txn)))


def _ordered(log: DataFrame) -> DataFrame:
    return log.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "captured"))).alias("seq"))


def final_versions(log: DataFrame) -> DataFrame:
    """entity, version, accepted: from version 1, an action applies if it captured the version that it meets."""
    zero = F.struct(F.lit(1).cast("long").alias("v"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.when(x["captured"] == a["v"], F.struct((a["v"] + 1).alias("v"), (a["n"] + 1).alias("n"))).otherwise(a)
    return _ordered(log).select("entity", F.aggregate("seq", zero, step).alias("s")).select("entity", F.col("s.v").alias("version"), F.col("s.n").alias("accepted"))


def outcomes(log: DataFrame) -> DataFrame:
    """entity, pos, accepted for every action. The versions at the begin of chunks of the entity's actions come first, by a fold that keeps nothing else; each
    chunk is then folded on its own, so the work stays linear in an entity's actions up to CHUNK^2 of them."""
    kind = "struct<v: bigint, at: array<bigint>>"
    chunk = F.transform(F.sequence(F.lit(0), F.floor((F.size("seq") - 1) / CHUNK).cast("int")), lambda k: F.slice("seq", k * CHUNK + 1, F.lit(CHUNK)))
    chunks = _ordered(log).select("entity", chunk.alias("chunks"))
    after = lambda v, seq: F.aggregate(seq, v, lambda a, x: F.when(x["captured"] == a, a + 1).otherwise(a))
    starts = F.aggregate("chunks", F.from_json(F.lit('{"v": 1, "at": []}'), kind), lambda a, c: F.struct(after(a["v"], c).alias("v"), F.concat(a["at"], F.array(a["v"])).alias("at")))
    each = chunks.select("entity", F.explode(F.arrays_zip(F.col("chunks"), starts["at"].alias("v"))).alias("c")).select("entity", F.col("c.chunks").alias("seq"), F.col("c.v").alias("v"))

    def step(a, x):
        ok = x["captured"] == a["v"]
        return F.struct(F.when(ok, a["v"] + 1).otherwise(a["v"]).alias("v"), F.concat(a["done"], F.array(F.struct(x["pos"].alias("pos"), ok.alias("accepted")))).alias("done"))

    zero = F.struct(F.col("v").alias("v"), F.array().cast("array<struct<pos: bigint, accepted: boolean>>").alias("done"))
    return each.select("entity", F.explode(F.aggregate("seq", zero, step)["done"]).alias("o")).select("entity", "o.pos", "o.accepted")


def validated_reads(reads: DataFrame, tables: DataFrame) -> DataFrame:
    """reads(tbl_id, version) that still hold."""
    return reads.join(tables.select("tbl_id", "version"), ["tbl_id", "version"], "left_semi")


#: The kinds of actions, with what each writes and what it needs unchanged. `ns`, `parent` and `tbl` stand for versions, `root` is exempt.
KINDS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("create_namespace", ("ns",), ("ns",)),
    ("drop_namespace", ("ns",), ("ns",)),
    ("set_property", ("ns",), ("ns",)),
    ("remove_property", ("ns",), ("ns",)),
    ("create_table", ("ns",), ("ns",)),
    ("create_table_inline", ("ns",), ("ns",)),
    ("drop_table", ("ns", "tbl"), ("tbl",)),
    ("update_table", ("tbl",), ("tbl",)),
    ("update_table_inline", ("tbl",), ("tbl",)),
    ("read_table", (), ("tbl",)),
)


def _on_one(kind: str, s: state.State) -> dict:
    """An action of the kind on namespace 1 or table 1, with the versions of s."""
    v, t = s.version("ns", 1), s.version("tbl", 1)
    made = {"version": 1, "namespace_id": 1, "namespace_version": v}
    return {"kind": kind} | {
        "create_namespace": {"id": 7, "version": 1, "parent_id": 1, "parent_version": v, "name": "x"}, "drop_namespace": {"id": 1, "version": v},
        "set_property": {"namespace_id": 1, "namespace_version": v, "key": "k", "value": "v"}, "remove_property": {"namespace_id": 1, "namespace_version": v, "key": "k"},
        "create_table": {"id": 8, "name": "y", "metadata_location": "l", **made}, "create_table_inline": {"id": 9, "name": "z", "metadata": b"{}", **made},
        "drop_table": {"id": 1, "version": t}, "read_table": {"id": 1, "version": t},
        "update_table": {"id": 1, "version": t, "metadata_location": "m"}, "update_table_inline": {"id": 1, "version": t, "metadata": b"{}"},
    }[kind]


def conflict_matrix(spark) -> DataFrame:
    """For each ordered pair of kinds on one namespace and table: whether the second, captured before the first, fails after it. The fold itself is asked, so
    this is what replays do; ten kinds make a hundred rows."""
    rows = []
    for first, *_ in KINDS:
        for second, *_ in KINDS:
            s = state.State(namespaces={1: {"parent_id": 0, "name": "n", "version": 1}}, tables={1: state.Table(1, "t", 1, "l")})
            a, b = _on_one(first, s), _on_one(second, s)
            s.commit({"txn_id": "00000000-0000-0000-0000-000000000001", "actions": [a]})
            rows.append((first, second, not s.holds(b)))
    return spark.createDataFrame(rows, "first string, second string, conflicts boolean")


def commit_modes(log: DataFrame, limit: int) -> DataFrame:
    """pos, mode of commits in order: with at most `limit` records in the log, every limit-th commit replaces the file."""
    n = F.row_number().over(Window.partitionBy("entity").orderBy("pos"))
    mode = F.lit("cas") if limit < 1 else F.when((n - 1) % limit == 0, "cas").otherwise("append")
    return log.select("entity", "pos", mode.alias("mode"))
