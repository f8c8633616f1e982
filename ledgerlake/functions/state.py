"""The lake's state and the fold of its log, for one lake: what a group of a distributed replay runs, and what the tests compare with."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from . import codec, table_metadata

ROOT = 0


@dataclass
class Table:
    namespace_id: int
    name: str
    version: int
    location: str | None = None
    metadata: bytes | None = None
    prefix: str = ""
    #: path to manifest, in order of first insertion
    pool: dict[str, dict] = field(default_factory=dict)
    #: snapshot to paths, in order
    refs: dict[int, list[str]] = field(default_factory=dict)


@dataclass
class State:
    uuid: str = "00000000-0000-0000-0000-000000000000"
    namespaces: dict[int, dict] = field(default_factory=dict)  # parent_id, name, version
    tables: dict[int, Table] = field(default_factory=dict)
    properties: dict[int, dict[str, str]] = field(default_factory=dict)
    committed: dict[str, None] = field(default_factory=dict)
    stored_next_namespace: int = 1
    stored_next_table: int = 1
    sealed: bool = False
    appends: int = 0

    # The counters never lie behind the ids in use, whatever the log did.
    @property
    def next_namespace(self) -> int:
        return max(self.stored_next_namespace, max(self.namespaces, default=0) + 1)

    @property
    def next_table(self) -> int:
        return max(self.stored_next_table, max(self.tables, default=0) + 1)

    def version(self, kind: str, i: int) -> int:
        if kind == "ns":
            return self.namespaces[i]["version"] if i in self.namespaces else -1
        return self.tables[i].version if i in self.tables else -1

    def bump(self, ns: int) -> None:
        if ns in self.namespaces:
            self.namespaces[ns]["version"] += 1

    def path(self, ns: int) -> tuple[str, ...]:
        names: list[str] = []
        while ns != ROOT:
            names.append(self.namespaces[ns]["name"])
            ns = self.namespaces[ns]["parent_id"]
        return tuple(reversed(names))

    def holds(self, a: dict) -> bool:
        """Whether an action's precondition holds."""
        kind = a["kind"]
        if kind == "create_namespace":
            return a["parent_id"] == ROOT or a["parent_version"] < 0 or a["parent_version"] == self.version("ns", a["parent_id"])
        if kind == "drop_namespace":
            return self.version("ns", a["id"]) == a["version"]
        if kind in ("set_property", "remove_property", "create_table", "create_table_inline"):
            return a["namespace_version"] < 0 or a["namespace_version"] == self.version("ns", a["namespace_id"])
        if kind in ("drop_table", "update_table", "read_table", "update_table_inline"):
            return self.version("tbl", a["id"]) == a["version"]
        return True

    def do(self, a: dict) -> None:
        kind = a["kind"]
        if kind == "create_namespace":
            self.namespaces[a["id"]] = {"parent_id": a["parent_id"], "name": a["name"], "version": max(a["version"], 1)}
            self.bump(a["parent_id"])
        elif kind == "drop_namespace":
            gone = self.namespaces.pop(a["id"], None)
            self.properties.pop(a["id"], None)
            if gone:
                self.bump(gone["parent_id"])
        elif kind == "set_property":
            self.properties.setdefault(a["namespace_id"], {})[a["key"]] = a["value"] or ""
            self.bump(a["namespace_id"])
        elif kind == "remove_property":
            left = self.properties.get(a["namespace_id"], {})
            left.pop(a["key"], None)
            if not left:
                self.properties.pop(a["namespace_id"], None)
            self.bump(a["namespace_id"])
        elif kind in ("create_table", "create_table_inline"):
            self.tables[a["id"]] = Table(a["namespace_id"], a["name"], max(a["version"], 1), a.get("metadata_location"), a.get("metadata"))
            self.bump(a["namespace_id"])
        elif kind == "drop_table":
            if dropped := self.tables.pop(a["id"], None):
                self.bump(dropped.namespace_id)
        elif kind in ("update_table", "update_table_inline") and a["id"] in self.tables:
            self.update(self.tables[a["id"]], a)

    def update(self, t: Table, a: dict) -> None:
        """The update of a table that is there: actions before it in the transaction may have dropped it. The version is
        one more than the captured one, however many updates of the table a transaction has."""
        after = max(a["version"] + 1, 1)
        if a["kind"] == "update_table" or a.get("delta") is None and a.get("metadata") is None and a.get("metadata_location") is not None:
            t.location, t.metadata, t.pool, t.refs, t.version = a["metadata_location"], None, {}, {}, after
        elif a.get("delta") is not None:
            if t.location is None:  # where metadata isn't inline, a delta has nothing to change
                self.patch(t, codec.decode("Delta", a["delta"])["updates"])
                t.version = after
        elif a.get("metadata") is not None:
            t.metadata, t.location, t.version = a["metadata"], None, after

    def patch(self, t: Table, updates: list[dict]) -> None:
        """A delta on a table: its metadata, and its pool with the snapshots' references."""
        base = json.loads(t.metadata or b"{}")
        table_metadata.check_order(updates, {s["snapshot-id"] for s in base.get("snapshots", [])})
        after = table_metadata.apply(base, updates, t.prefix)
        by_id = {s["snapshot-id"]: s for s in after.get("snapshots", [])}
        if t.pool or t.refs or any(u["kind"] == "add_manifest" for u in updates):
            # a snapshot without a list of its own begins with its parent's
            for u in updates:
                if u["kind"] == "add_snapshot" and not u.get("manifest_list_suffix"):
                    parent = by_id.get(u["snapshot_id"], {}).get("parent-snapshot-id")
                    t.refs.setdefault(u["snapshot_id"], list(t.refs.get(parent, [])))
        for u in updates:
            if u["kind"] == "add_manifest":
                entry = dict(u["manifest"], path=t.prefix + (u["manifest"]["path"] or ""))
                t.pool[entry["path"]] = entry
                mine = t.refs.setdefault(u["snapshot_id"], [])
                if entry["path"] not in mine:
                    mine.append(entry["path"])
            elif u["kind"] == "remove_manifest":
                t.refs[u["snapshot_id"]] = [p for p in t.refs.get(u["snapshot_id"], []) if p != t.prefix + u["path"]]
            elif u["kind"] == "remove_snapshots":
                self.forget(t, u["snapshot_ids"])
        t.metadata = json.dumps(after, separators=(",", ":")).encode()

    @staticmethod
    def forget(t: Table, snapshots: list[int]) -> None:
        """Drop snapshots' references, and the manifests that only they held."""
        held = {p for s in snapshots for p in t.refs.pop(s, [])}
        left = {p for paths in t.refs.values() for p in paths}
        for p in held - left:
            t.pool.pop(p, None)

    def commit(self, txn: dict) -> bool:
        """Applies a transaction if all its preconditions hold against the state before it. Where an earlier action of it has
        dropped what a later one names, the later one has nothing to do."""
        if not all(self.holds(a) for a in txn["actions"]):
            return False
        for a in txn["actions"]:
            self.do(a)
        self.committed[txn["txn_id"]] = None
        return True

    def replay(self, records) -> State:
        """Records in order: applied ones are skipped when they come again, rejected ones are tried again, a seal ends the log."""
        for record in records:
            txn = codec.decode("Transaction", record) if isinstance(record, (bytes, bytearray)) else record
            self.appends += 1
            if txn["txn_id"] in self.committed:
                continue
            self.commit(txn)
            if txn["sealed"]:
                self.sealed = True
                break
        return self


def from_checkpoint(b: bytes) -> State:
    c = codec.decode("Checkpoint", b)
    s = State(c["lake_uuid"] or State.uuid, stored_next_namespace=c["next_namespace_id"] or 1, stored_next_table=c["next_table_id"] or 1)
    s.committed = dict.fromkeys(c["committed"])
    for n in c["namespaces"]:
        s.namespaces[n["id"]] = {"parent_id": n["parent_id"] or ROOT, "name": n["name"] or "", "version": n["version"] or 0}
    for t in c["tables"]:
        s.tables[t["id"]] = Table(t["namespace_id"] or ROOT, t["name"] or "", t["version"] or 0, t["metadata_location"])
    for p in c["namespace_properties"]:
        s.properties.setdefault(p["namespace_id"], {})[p["key"]] = p["value"] or ""
    for t in c["inline_tables"]:
        prefix = t["manifest_prefix"] or ""
        entries = [dict(m, path=prefix + (m["path"] or "")) for m in t["manifest_pool"]]
        refs = {r["snapshot_id"]: [entries[k]["path"] for k in r["pool_indices"] if 0 <= k < len(entries)] for r in t["snapshot_refs"]}
        s.tables[t["id"]] = Table(t["namespace_id"] or ROOT, t["name"] or "", t["version"] or 0, None, t["metadata"] or b"", prefix, {m["path"]: m for m in entries}, refs)
    return s


def to_checkpoint(s: State) -> bytes:
    inline = []
    for i, t in s.tables.items():
        if t.location is None:
            at = {p: k for k, p in enumerate(t.pool)}
            inline.append({
                "id": i, "version": t.version, "namespace_id": t.namespace_id, "name": t.name, "metadata": t.metadata or b"", "manifest_prefix": t.prefix,
                "manifest_pool": [dict(m, path=p.removeprefix(t.prefix)) for p, m in t.pool.items()],
                "snapshot_refs": [{"snapshot_id": k, "pool_indices": [at[p] for p in paths if p in at]} for k, paths in t.refs.items()],
            })
    return codec.encode("Checkpoint", {
        "lake_uuid": s.uuid, "next_namespace_id": s.next_namespace, "next_table_id": s.next_table,
        "namespaces": [{"id": i, **n} for i, n in s.namespaces.items()],
        "tables": [{"id": i, "version": t.version, "namespace_id": t.namespace_id, "name": t.name, "metadata_location": t.location} for i, t in s.tables.items() if t.location is not None],
        "namespace_properties": [{"namespace_id": i, "key": k, "value": v} for i, p in s.properties.items() for k, v in p.items()],
        "inline_tables": inline, "committed": list(s.committed),
    })


def load(b: bytes) -> State:
    checkpoint, records = codec.split_file(b)
    return from_checkpoint(checkpoint).replay(records)
