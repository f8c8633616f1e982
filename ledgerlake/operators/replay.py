"""Replay of whole lakes on the executors: files are decoded and folded where they are read, one lake in one task at a time.

A lake's log is sequential, since one transaction may touch several entities; its size is bounded by the limits at which
writers compact it, so the unit of parallelism is the lake, and any number of lakes is replayed at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, state
from ..functions.shipping import ship

#: The relations of a lake and their columns.
RELATIONS: dict[str, str] = {
    "namespaces": "lake string, ns_id int, parent_id int, name string, version int",
    "tables": "lake string, tbl_id int, ns_id int, name string, version int, location string, metadata string, manifest_prefix string",
    "properties": "lake string, ns_id int, key string, value string",
    "manifest_pool": "lake string, tbl_id int, pool_idx int, path string, length long, content int, added_rows long",
    "snapshot_refs": "lake string, tbl_id int, snapshot_id long, ord int, path string",
    "committed": "lake string, txn_id string",
    "lakes": "lake string, uuid string, next_ns_id int, next_tbl_id int, sealed boolean, appends int",
}


def rows_of(lake: str, s: state.State, relation: str) -> Iterator[tuple]:
    if relation == "namespaces":
        yield from ((lake, i, n["parent_id"], n["name"], n["version"]) for i, n in s.namespaces.items())
    elif relation == "tables":
        yield from ((lake, i, t.namespace_id, t.name, t.version, t.location, t.metadata.decode() if t.metadata is not None else None, t.prefix) for i, t in s.tables.items())
    elif relation == "properties":
        yield from ((lake, i, k, v) for i, p in s.properties.items() for k, v in p.items())
    elif relation == "manifest_pool":
        yield from ((lake, i, k, m["path"], m.get("length"), m.get("content"), m.get("added_rows")) for i, t in s.tables.items() for k, m in enumerate(t.pool.values()))
    elif relation == "snapshot_refs":
        yield from ((lake, i, snap, k, p) for i, t in s.tables.items() for snap, paths in t.refs.items() for k, p in enumerate(paths))
    elif relation == "committed":
        yield from ((lake, t) for t in s.committed)
    else:
        yield (lake, s.uuid, s.next_namespace, s.next_table, s.sealed, s.appends)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def replayed(files: DataFrame, relation: str) -> DataFrame:
    """files(lake, content): one relation of every lake, after its log. A lake's state never leaves its task."""
    schema = RELATIONS[relation]
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            found = [r for c, x in zip(b["lake"], b["content"]) for r in rows_of(c, state.load(bytes(x)), relation)]
            yield pd.DataFrame(found, columns=_names(schema)).astype(object)

    return files.mapInPandas(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Lake files under a path that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("lake"), "content")


def replay_transactions(log: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """log(lake, pos, record): table versions of each lake after its ordered records, begun from checkpoints(lake, checkpoint) if given."""
    schema = "lake string, tbl_id int, version int, location string"
    ship(log.sparkSession)
    both = log.select("lake", "pos", "record")
    if checkpoints is not None:
        both = both.unionByName(checkpoints.select("lake", F.lit(-(1 << 62)).cast("long").alias("pos"), F.col("checkpoint").alias("record")))

    def fold(pdf):
        pdf = pdf.sort_values("pos")
        begin = pdf["pos"].iloc[0] == -(1 << 62)
        s = state.from_checkpoint(bytes(pdf["record"].iloc[0])) if begin else state.State()
        s.replay(bytes(r) for r in pdf["record"].iloc[int(begin) :])
        c = pdf["lake"].iloc[0]
        return pd.DataFrame([(c, i, t.version, t.location) for i, t in s.tables.items()], columns=["lake", "tbl_id", "version", "location"])

    return both.groupBy("lake").applyInPandas(fold, schema)


def decoded_log(files: DataFrame) -> DataFrame:
    """The records of each lake's log as rows: lake, pos, txn_id, sealed, actions (with kind and the ids and versions that conflicts turn on)."""
    schema = "lake string, pos long, txn_id string, sealed boolean, actions array<struct<kind: string, id: int, version: int, namespace_id: int, namespace_version: int, name: string, key: string, value: string>>"
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for c, x in zip(b["lake"], b["content"]):
                for pos, r in enumerate(codec.split_file(bytes(x))[1]):
                    t = codec.decode("Transaction", r)
                    keys = ("kind", "id", "version", "namespace_id", "namespace_version", "name", "key", "value")
                    out.append((c, pos, t["txn_id"], bool(t["sealed"]), [{k: a.get(k) for k in keys} for a in t["actions"]]))
            yield pd.DataFrame(out, columns=_names("lake string, pos long, txn_id string, sealed boolean, actions x"))

    return files.mapInPandas(run, schema)
